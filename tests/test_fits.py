"""Matching, fits, contracts, lenses and rasters against known answers and brute force."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solstice.functions import lens as L
from solstice.functions.numeric import round_half_even_ratio
from solstice.operators import contracts as C
from solstice.operators import matching, motion, raster


def turn(axis, angle):
    q = motion.exp_rotation(np.asarray(axis, float) * angle)
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_timing_fit(spark):
    rng = np.random.default_rng(1)
    truth, rows = {}, []
    for source in "abc":
        shift, scale, readout = truth[source] = rng.uniform(-0.05, 0.05), rng.uniform(0.3, 2.5), 0.037
        for _ in range(150):
            dt, row, rate, change = rng.uniform(0.01, 0.2), rng.uniform(-1, 1), rng.uniform(-2, 2), rng.uniform(-5, 5)
            rows.append((source, dt, row, rate * (dt + scale * readout * row) + change * shift, rate, change))
    found = motion.fit_timing(spark.createDataFrame(rows, "source string, dt double, rows double, angle double, rate double, rate_change double"), 0.037).collect()
    assert len(found) == 3
    for r in found:
        assert r["shift"] == pytest.approx(truth[r.source][0], abs=1e-9) and r["scale"] == pytest.approx(truth[r.source][1], abs=1e-6) and r["rms"] < 1e-6


def cheapest_ring(cost, penalty):
    """The least cost of a path over the columns that ends in the row where it began, by relaxing every start row by itself."""
    rows, n = cost.shape
    best = np.inf
    for start in range(rows):
        reach = np.full(rows, np.inf)
        reach[start] = cost[start, 0]
        for k in range(1, n):
            reach = np.array([min(reach[i] + penalty * (i != j) for i in range(max(0, j - 1), min(rows, j + 2))) for j in range(rows)]) + cost[:, k]
        best = min(best, reach[start])
    return best


@pytest.mark.parametrize("rows, n", [(2, 9), (5, 3), (6, 25), (9, 12), (3, 2)])
def test_closed_path_costs_no_more_than_any_other(spark, rows, n):
    rng = np.random.default_rng(rows * 100 + n)
    for penalty in (0.0, 0.4, 3.0):
        cost = rng.gamma(0.7, 4.0, (rows, n))
        path, value = raster.closed_path(cost, penalty)
        steps = np.abs(np.diff(path))
        assert value == pytest.approx(cheapest_ring(cost, penalty)) and path[0] == path[-1] and steps.max() <= 1
        assert value == pytest.approx(cost[path, np.arange(n)].sum() + penalty * steps.sum())


def test_strips_equal_the_whole_image(spark):
    rng = np.random.default_rng(8)
    eyes = [rng.integers(0, 255, (64, 64), np.uint8).tobytes() for _ in range(2)]
    frames = spark.createDataFrame([("a", 0, 64, bytearray(eyes[0]), bytearray(eyes[1]))], "source string, frame long, size int, front binary, back binary")
    lens = L.Lens(1.5, 40.0, 40.0, 31.5, 31.5, 64)
    whole = raster.render_spheres(frames, 64, 32, lens, lens, strip=32).first().pixels
    parts = raster.render_spheres(frames, 64, 32, lens, lens, strip=8).orderBy("strip").collect()
    assert b"".join(bytes(p.pixels) for p in parts) == bytes(whole)


def test_constant_lenses_give_a_constant_sphere(spark):
    flat = bytearray(np.full((64, 64), 99, np.uint8).tobytes())
    frames = spark.createDataFrame([("a", 0, 64, flat, flat)], "source string, frame long, size int, front binary, back binary")
    lens = L.Lens(1.5, 30.0, 30.0, 31.5, 31.5, 64)
    pixels = np.frombuffer(bytes(raster.render_spheres(frames, 64, 32, lens, lens).first().pixels), np.uint8)
    assert set(pixels.tolist()) <= {0, 99} and (pixels == 99).mean() > 0.9


def test_pixels_and_rays_are_inverse(spark):
    g = raster.pixel_grid(spark, 16, 8).withColumn("r", L.pixel_ray(F.col("col"), F.col("row"), 16, 8))
    back = g.withColumn("p", L.ray_pixel(F.col("r.x"), F.col("r.y"), F.col("r.z"), 16, 8))
    assert back.where("abs(p.column - col) > 1e-9 or abs(p.row - row) > 1e-9").count() == 0


def test_half_even_ratio_is_exact(spark):
    cases = [(k, d) for k in range(-12, 13) for d in (1, 2, 3, 4, 7)] + [(10**25 + k, 20) for k in range(-12, 13)]
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in cases], "a string, b string").select(F.col("a").cast("decimal(38,0)").alias("a"), F.col("b").cast("decimal(38,0)").alias("b"))
    for r in rows.withColumn("q", round_half_even_ratio(F.col("a"), F.col("b"))).collect():
        assert int(r.q) == round(Fraction(int(r.a), int(r.b)))


def test_contracts(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id long, v double")
    found = C.violations(df, "id", {"positive": F.col("v") > 0, "small": F.col("v") < 3})
    assert sorted((r.id, r.rule) for r in found.collect()) == [(1, "small"), (2, "positive"), (2, "small"), (3, "positive")]
    with pytest.raises(C.ContractError):
        C.require(found, "values")
    C.require(found.where("false"), "values")


def test_medoids_of_random_candidates(spark):
    rng = np.random.default_rng(44)
    groups = {g: np.round(rng.normal(rng.choice([0.0, 5.0], size=n), rng.choice([0.1, 0.6, 3.0])), 3) for g, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 23])}
    fits = spark.createDataFrame([(g, k, float(v)) for g, values in groups.items() for k, v in enumerate(values)], "grp int, item long, v double")
    out = {r.grp: r for r in matching.medoid(fits, "grp", "item", lambda a, b: F.round(F.abs(F.col("a.v") - F.col("b.v")), 6), 0.4).collect()}
    assert out.keys() == groups.keys()
    for g, values in groups.items():
        d = np.round(np.abs(values[:, None] - values), 6)
        best = min(range(len(values)), key=lambda k: (np.median(d[k]), k))
        near = int((d[best] <= 0.4).sum())
        assert (out[g]["item"], out[g].consistent) == (best, near)
        assert out[g].accepted == (near >= max(1, len(values) // 2 + 1 if len(values) > 1 else 1))
    assert {r.accepted for r in out.values()} == {True, False}


def test_robust_rotation_query_fits_small_groups_of_all_rows(spark):
    from solstice.plans import geometry_queries

    sf, right = "/root/testdata/sf0.1", {}
    for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id").collect():
        right.setdefault((x.label, x.vec_id // 500), []).append(x.vec_id % 4 != 0)
    out = {(x.label, x.block): x for x in geometry_queries.ransac_rotation(spark, sf).collect()}
    assert out.keys() == right.keys() and all(out[k].pairs == len(v) <= 500 for k, v in right.items()) and sum(map(len, right.values())) == 2000
    for k, v in right.items():  # the wrong ones of a group are turned alike
        assert out[k].inliers >= max(sum(v), len(v) - sum(v)) or out[k].status == "rejected" and len(v) < 12


def test_medoids_of_all_vectors_equal_brute_force(spark):
    from solstice.plans import relational_queries

    sf = "/root/testdata/sf0.01"
    groups = {}
    for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        groups.setdefault((x.label, x.vec_id // 120), []).append((x.vec_id, np.array(x.embedding, float)))
    out = {(x.label, x.block): x for x in relational_queries.medoid_blocks(spark, sf).collect()}
    assert out.keys() == groups.keys() and sum(x.n for x in out.values()) == sum(map(len, groups.values())) == 500
    for key, items in groups.items():
        d = np.array([[round(float(np.linalg.norm(v - w)), 9) for _, w in items] for _, v in items])
        middle, best = min((round(float(np.median(row)), 9), i) for (i, _), row in zip(items, d))
        near = int((d[[i for i, _ in items].index(best)] <= 1.4).sum())
        x = out[key]
        assert (x.vec_id, x.n, x.consistent, x.accepted) == (best, len(items), near, near > len(items) // 2 or len(items) == 1)
        assert x.median_distance == pytest.approx(middle, abs=2e-6)


def test_a_medoid_of_many_like_candidates_meets_few_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 30, 60_000) / 10
    fits = spark.createDataFrame(pd.DataFrame({"grp": 0, "item": rng.permutation(60_000), "v": v}))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def apart(a, b):
        seen.add(1)
        return abs(a - b)

    [out] = matching.medoid(fits, "grp", "item", lambda a, b: apart(F.col("a.v"), F.col("b.v")), 0.75).collect()
    of = {x: float(np.median(np.abs(v - x))) for x in np.unique(v)}
    items = fits.toPandas()
    best = min(of, key=lambda x: (of[x], items[items.v == x].item.min()))
    assert out["item"] == items[items.v == best].item.min() and out.n == 60_000 and out.consistent == (np.abs(v - best) <= 0.75).sum() and abs(out.median_distance - of[best]) < 1e-12
    assert seen.value <= 4 * 30 * 30
