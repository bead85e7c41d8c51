"""Flow trust, picture statistics and matched rotations against plain NumPy."""

import numpy as np
import pandas as pd

from solstice.operators import frames, neighbours

RNG = np.random.default_rng(9)


def field(spark, fx, fy, texture, valid):
    rows, cols = np.indices(fx.shape)
    return spark.createDataFrame(pd.DataFrame({"frame": 1, "row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32), "fx": fx.ravel(), "fy": fy.ravel(), "texture": texture.ravel(), "valid": valid.ravel()}))


def test_flow_trust_equals_numpy(spark):
    h, w = 9, 12
    fx, fy = RNG.normal(0, 1.2, (h, w)), RNG.normal(0, 0.8, (h, w))
    bx, by = -fx + RNG.normal(0, 0.3, (h, w)), -fy + RNG.normal(0, 0.3, (h, w))
    fx[2, 3], bx[5, 5] = np.nan, np.inf
    texture, valid = RNG.uniform(0, 15, (h, w)), RNG.random((h, w)) > 0.1
    got = {(r.row, r.col): r.trust for r in frames.flow_trust(field(spark, fx, fy, texture, valid), field(spark, bx, by, texture, valid), w, 0.01, 0.02).collect()}
    ease = lambda t: (t := min(1, max(0, t))) ** 2 * (3 - 2 * t)
    for i in range(h):
        for j in range(w):
            want = 0.0
            if valid[i, j] and np.isfinite(fx[i, j]):
                x, y = j + fx[i, j], i + fy[i, j]
                x0, y0 = int(np.floor(x)), int(np.floor(y))
                total, covered = np.zeros(2), 0.0
                for dx in (0, 1):
                    for dy in (0, 1):
                        c, r, weight = (x0 + dx) % w, y0 + dy, abs(1 - dx - (x - x0)) * abs(1 - dy - (y - y0))
                        if 0 <= r < h and valid[r, c] and np.isfinite(bx[r, c]):
                            total, covered = total + weight * np.array([bx[r, c], by[r, c]]), covered + weight
                if covered > 0.99 and np.hypot(fx[i, j] * 0.01, fy[i, j] * 0.02) < np.radians(2):
                    want = ease(1.5 - np.hypot(fx[i, j] + total[0], fy[i, j] + total[1])) * ease((texture[i, j] - 1) / 12)
            assert abs(got[i, j] - want) < 1e-9
    assert sum(v > 0 for v in got.values()) > 10


def test_matched_rotations_find_the_turn_and_refuse_few(spark):
    n, turn = 40, np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]])
    rays = RNG.normal(size=(n, 3))
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    descriptors = RNG.normal(size=(n, 8))

    def features(block, rays, noise, k):
        return pd.DataFrame({"block": block, "item": range(k), "d": (descriptors + noise * RNG.normal(size=descriptors.shape))[:k].tolist(), "x": rays[:k, 0], "y": rays[:k, 1], "z": rays[:k, 2]})

    make = lambda *x: spark.createDataFrame(pd.concat(x))
    out = {r.block: r for r in frames.matched_rotations(make(features(1, rays, 0.01, n), features(2, rays, 0.01, 5)), make(features(1, rays @ turn.T, 0, n), features(2, rays @ turn.T, 0, 5)), "block", "item", "d").collect()}
    assert out[1].status == "fitted" and out[1].pairs == n and np.abs(np.array(out[1].rotation).reshape(3, 3) - turn).max() < 1e-6
    assert out[2].status == "rejected"


def test_two_nearest_in_chunks_equal_brute_force(spark):
    a, b = RNG.integers(0, 3, (30, 4)).astype(float), RNG.integers(0, 3, (50, 4)).astype(float)
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 2, "i": np.arange(len(v)), "v": v.tolist()}))
    for size in (1, 7, 1000):
        got = {r.query_id: r for r in neighbours.nearest_two(frame(a), frame(b), "g", "i", "i", "v", 0.9, size).collect()}
        for i, v in enumerate(a):
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in enumerate(b) if j % 2 == i % 2)
            assert (got[i].base_id, got[i].d1, got[i].d2) == (d[0][1], d[0][0], d[1][0]) and got[i].kept == (d[0][0] < 0.9 * d[1][0])


def test_tiles_beyond_the_bounds_are_not_compared(spark):
    centres = RNG.normal(size=(30, 6)) * 20
    rows = [(g, k, (centres[RNG.integers(30)] + RNG.normal(size=6)).tolist()) for g in (None, "a", "b") for k in range(500 if g == "a" else 40)] + [("a", 1000, None), ("alone", 5, [1.0] * 6)]
    base = spark.createDataFrame(rows, "block string, item long, v array<double>").repartition(4)
    asks = spark.createDataFrame([(g, k, (np.array(v) + RNG.normal(size=6) * 0.1).tolist()) for g, k, v in rows if v and k % 3 == 0] + [("nowhere", 1, [0.0] * 6)], "block string, item long, v array<double>")
    best, met = neighbours.searched(asks, base, 20)
    got = {(r.block, r.query_id): [(x.d, x.id) for x in r.x] for r in best.collect()}
    want = {}
    for r in asks.collect():
        d = sorted((float(np.sqrt(((np.array(r.v) - np.array(v)) ** 2).sum())), k) for g, k, v in rows if v and g == r.block and g is not None)
        if d:
            want[r.block, r.item] = d[:2]
    assert got.keys() == want.keys()
    assert all([i for _, i in got[k]] == [i for _, i in want[k]] and np.allclose([d for d, _ in got[k]], [d for d, _ in want[k]]) for k in want)
    touched = {r.touched: r["count"] for r in met.groupBy("touched").count().collect()}
    assert touched[False] > 0.25 * (touched[True] + touched[False])
