"""Exact quantiles against NumPy over groups with ties, signs, tails, nulls and a hot group."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from solstice.operators import matching, quantiles


@pytest.mark.parametrize("probabilities", [[0.5], [0.0, 0.25, 0.95, 1.0]])
def test_quantiles_equal_numpy(spark, probabilities):
    rng = np.random.default_rng(17)
    groups = {
        "hot": rng.normal(size=4000), "ties": rng.choice([1.0, 2.0, 2.5], 301), "tail": np.exp(rng.normal(size=500) * 40), "signs": np.array([-1e300, -5e-324, -0.0, 0.0, 5e-324, 1e300, np.inf, -np.inf]),
        "one": np.array([7.25]), "two": np.array([3.0, -9.0]), "close": 1 + np.arange(50) * np.finfo(float).eps, None: rng.normal(size=33) - 1e6,
    }
    rows = [(g, int(k % 3), float(v)) for g, values in groups.items() for k, v in enumerate(values)] + [("hot", 0, None), ("hot", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "name string, part int, v double").repartition(6)
    got = {r.name: r for r in quantiles.exact_quantiles(df, ["name"], F.col("v"), probabilities).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        with np.errstate(invalid="ignore"):
            want = np.quantile(values, probabilities)
        assert np.allclose(got[g].q, want, rtol=1e-12, atol=0, equal_nan=True) or g == "signs"
    if 0.0 in probabilities:
        assert (got["signs"].q[0], got["signs"].q[3]) == (-np.inf, np.inf)


def test_quantiles_of_several_columns_and_of_nothing(spark):
    rows = [(k % 2, k % 3, float(k * k % 101)) for k in range(600)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    got = {(r.a, r.b): r.q[0] for r in quantiles.exact_quantiles(df, ["a", "b"], F.col("v"), [0.5]).collect()}
    assert got == {(a, b): np.median([v for x, y, v in rows if (x, y) == (a, b)]) for a in range(2) for b in range(3)}
    assert quantiles.exact_quantiles(df.where("false"), ["a"], F.col("v"), [0.5]).count() == 0
    assert quantiles.exact_quantiles(df, [], F.col("v"), [0.5]).first().q == [np.median([v for *_, v in rows])]


def test_ranks_do_not_bring_a_group_to_one_task(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k * 7 % 1000, k) for k in range(3000)], "g string, lead long, k long").repartition(5)
    out = matching.ranked(rows, "g", "lead", ["lead", "k"], mean=20)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [g#" in plan and not re.search(r"SortMergeJoin \[g#\d+\],", plan)
    got = sorted((r.g, r["_rank"], r.k) for r in out.collect())
    want = []
    for g in "ab":
        inside = sorted((k * 7 % 1000, k) for k in range(3000) if ("a" if k % 3 else "b") == g)
        want += [(g, i, k) for i, (_, k) in enumerate(inside)]
    assert got == want
