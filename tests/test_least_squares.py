"""Bounded least squares over parts, against a dense search on small problems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from solstice.operators import least_squares


def curve(part, p):
    return p[0] * np.exp(-p[1] * part["t"]) + p[2] - part["y"]


def test_fits_of_several_sources_do_not_depend_on_their_parts(spark):
    rng = np.random.default_rng(3)
    truth = {"a": (2.0, 0.7, 0.1), "b": (-1.0, 2.5, 3.0), "c": (0.5, 0.2, -1.0)}
    rows = [(s, int(k), float(t), float(curve({"t": t, "y": 0.0}, p) + rng.normal() * 1e-3)) for s, p in truth.items() for k, t in enumerate(rng.uniform(0, 4, 60))]
    df = spark.createDataFrame(rows, "source string, k int, t double, y double")
    starts = spark.createDataFrame([(s, [0.3, 1.0, 0.0], [-5.0, 0.01, -5.0], [5.0, 5.0, 5.0]) for s in truth], "source string, x array<double>, low array<double>, high array<double>")
    found = []
    for parts in (1, 7):
        pieces = df.groupBy("source", (F.col("k") % parts).alias("p")).agg(F.collect_list("t").alias("t"), F.collect_list("y").alias("y")).drop("p")
        found.append({r.source: r for r in least_squares.fit(pieces, starts, curve, [1.0, 1.0, 1.0]).collect()})
    for s, p in truth.items():
        one, many = (x[s] for x in found)
        assert one.settled and many.settled and np.allclose(one.x, many.x, atol=1e-6) and np.allclose(one.x, p, atol=0.02)
        mine = {"t": np.array([r[2] for r in rows if r[0] == s]), "y": np.array([r[3] for r in rows if r[0] == s])}
        cost = lambda q: float((curve(mine, q) ** 2).sum())
        assert many.sums[0] == pytest.approx(cost(np.array(many.x)))
        assert all(cost(np.array(many.x) + step) >= many.sums[0] * (1 - 1e-9) for step in rng.normal(size=(200, 3)) * 1e-3)


def test_bounds_hold_and_outliers_count_less(spark):
    parts = spark.createDataFrame([("line", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 1.0, 2.0, 3.0, 4.0, 50.0])], "source string, t array<double>, y array<double>")
    line = lambda part, p: p[0] * part["t"] - part["y"]
    start = lambda low, high: spark.createDataFrame([("line", [0.5], [low], [high])], "source string, x array<double>, low array<double>, high array<double>")
    plain = least_squares.fit(parts, start(-9.0, 99.0), line, [1.0]).first()
    soft = least_squares.fit(parts, start(-9.0, 99.0), line, [1.0], soft=0.01).first()
    held = least_squares.fit(parts, start(-9.0, 0.8), line, [1.0]).first()
    assert plain.x[0] == pytest.approx(280 / 55, abs=1e-6) and soft.x[0] == pytest.approx(1.0, abs=0.01) and held.x[0] == 0.8 and held.settled
    assert least_squares.fit(parts, start(-9.0, 9.0).where("false"), line, [1.0]).count() == 0
