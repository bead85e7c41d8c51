"""Interpolation and padding around a ring, and the rules of metadata fields."""

import numpy as np
import pytest

from solstice.operators import gates, interpolation


def test_periodic_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(6)
    knots = {s: (np.sort(rng.choice(360, n, replace=False)) - 180.0, rng.normal(size=n)) for s, n in (("a", 9), ("b", 1), ("c", 2))}
    rows = [(s, float(x), float(y)) for s, (xs, ys) in knots.items() for x, y in zip(xs, ys, strict=True)]
    asks = [(k, s, float(x)) for k, (s, x) in enumerate((s, x) for s in "abcd" for x in (*rng.uniform(-800, 800, 20), 0.0, 360.0, knots["a"][0][3]))]
    got = {r.id: r for r in interpolation.periodic_linear(spark.createDataFrame(asks, "id int, source string, x double"), spark.createDataFrame(rows, "source string, x double, y double"), "x", "y", 360.0).collect()}
    assert len(got) == len(asks)
    for k, s, x in asks:
        assert got[k].x == x
        assert got[k].y is None if s == "d" else abs(got[k].y - np.interp(x, *knots[s], period=360)) < 1e-9


def test_padding_wraps(spark):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(2) for c in range(5)], "row int, col int, v int")
    for pad in (0, 1, 3, 5):
        got = sorted((x.row, x.col, x.v) for x in interpolation.wrap_columns(cells, "col", 5, pad).collect())
        assert got == [(r, c - pad, 10 * r + v) for r in range(2) for c, v in enumerate(np.pad(np.arange(5), pad, mode="wrap").tolist())]
    with pytest.raises(ValueError):
        interpolation.wrap_columns(cells, "col", 5, 6)


def test_metadata_rules(spark):
    fields = [("a", 2, 2), ("a", 2, 2), ("a", 24, 0), ("b", 25, 0), ("b", 25, 1), ("b", 99, 0), ("b", 99, 5), ("c", 208, 0), ("c", 65, 2)]
    got = gates.metadata_violations(spark.createDataFrame(fields, "source string, number int, wire int")).collect()
    assert sorted((r.source, r.number, r.rule) for r in got) == [("a", 2, "twice"), ("b", 25, "twice"), ("b", 25, "wire type")]
