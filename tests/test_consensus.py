"""Robust rotations of groups of any size, against NumPy over the same trials."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from solstice.operators import consensus
from solstice.operators.motion import exp_rotation, product

COLUMNS = "g string, p int, ax double, ay double, az double, bx double, by double, bz double"


def turned(q, v):
    return product(product(q, np.concatenate([v, np.zeros((len(v), 1))], axis=1)), q * [-1, -1, -1, 1])[:, :3]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(12)
    out = {}
    for g, (n, right, noise) in {"large": (900, 0.5, 0.004), "half": (80, 0.5, 0.0), "few": (5, 1.0, 0.0), "wild": (60, 0.0, 0.0), "alike": (30, 1.0, 0.0), "odd": (40, 1.0, 0.0)}.items():
        a = rng.normal(size=(n, 3))
        if g == "alike":
            a[:] = a[0]
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = turned(exp_rotation(rng.uniform(-1, 1, 3))[None], a) + noise * rng.normal(size=(n, 3))
        wrong = rng.random(n) >= right
        b[wrong] = rng.normal(size=(wrong.sum(), 3))
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        out[g] = a, b
    out["odd"][1][3, 1] = np.nan
    return out


@pytest.fixture(scope="module")
def pairs(spark, groups):
    rng = np.random.default_rng(1)
    rows = [(g, 7, *map(float, x), *map(float, y)) for g, (a, b) in groups.items() for x, y in zip(a, b, strict=True)]
    return spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], COLUMNS).repartition(5)


def test_trials_are_fits_of_three_different_rows(spark, pairs):
    rows = consensus.numbered_pairs(pairs.where("g <> 'odd'"), ["g"])
    trials = consensus.trial_rotations(rows, 40, 3).collect()
    assert {(r.g.g, r.trial) for r in trials} == {(g, k) for g in ("large", "half", "few", "wild", "alike") for k in range(40)}
    for r in trials:
        m = np.array(r.rotation).reshape(3, 3)
        assert np.abs(m @ m.T - np.eye(3)).max() < 1e-9 and np.linalg.det(m) > 0.99


@pytest.mark.parametrize("chunk", [16, 1 << 14])
def test_consensus_equals_numpy_over_the_same_trials(spark, pairs, groups, chunk):
    kept = pairs.where("g <> 'odd'")
    trials = {}
    for r in consensus.trial_rotations(consensus.numbered_pairs(kept, ["g", "p"], chunk), 60, 3).collect():
        trials.setdefault(r.g.g, {})[r.trial] = np.array(r.rotation).reshape(3, 3)
    got = {r.g: r for r in consensus.robust_rotations(pairs, ["g", "p"], 1.0, 60, 3, 6, 0.2, 0.05, chunk).collect()}
    assert set(got) == set(groups) and all(r.p == 7 for r in got.values())
    for g, (a, b) in groups.items():
        r = got[g]
        assert r.pairs == len(a)
        if g in ("few", "odd"):
            assert r.status == "rejected" and r.inliers == 0
            continue
        inside = {k: ((a @ m.T) * b).sum(axis=1) >= np.cos(np.radians(1.0)) for k, m in trials[g].items()}
        best = inside[min(inside, key=lambda k: (-inside[k].sum(), k))]
        assert r.inliers == best.sum()
        axis = np.linalg.svd(a[best], compute_uv=False)[-1] if best.sum() >= 3 else 0.0
        if best.sum() < 6 or best.sum() < 0.2 * len(a) or axis < 0.05:
            assert r.status == "rejected" and r.rotation is None and r.median_error is None
            continue
        u, _, vt = np.linalg.svd(a[best].T @ b[best])
        m = vt.T @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ u.T
        error = np.degrees(np.arccos(np.clip(((a[best] @ m.T) * b[best]).sum(axis=1), -1, 1)))
        assert r.status == "fitted" and np.abs(np.array(r.rotation).reshape(3, 3) - m).max() < 1e-9
        assert abs(r.median_error - np.median(error)) < 1e-6 and abs(r.p95_error - np.percentile(error, 95)) < 1e-6
    assert {got[g].status for g in ("large", "half")} == {"fitted"} and {got[g].status for g in ("wild", "alike")} == {"rejected"}


def test_a_large_group_is_many_chunks_and_nothing_gives_nothing(spark, pairs):
    rows = consensus.numbered_pairs(pairs.where("g = 'large'"), ["g"], 100)
    assert sorted(r["count"] for r in rows.groupBy("chunk").count().collect()) == [100] * 9
    assert consensus.robust_rotations(pairs.where("false"), "g").count() == 0
    assert rows.agg(F.count_distinct("k")).first()[0] == 900


@pytest.mark.parametrize("chunk", [16, 1 << 14])
def test_votes_fit_the_same_trials_in_their_tasks(spark, pairs, groups, chunk, monkeypatch):
    rows = consensus.numbered_pairs(pairs.where("g <> 'odd'"), ["g"], chunk)
    trials = {}
    for r in consensus.trial_rotations(rows, 40, 3).collect():
        a, b = groups[r.g.g]
        inside = ((a @ np.array(r.rotation).reshape(3, 3).T) * b).sum(axis=1) >= np.cos(0.02)
        trials[r.g.g, r.trial] = int(inside.sum())
    got = {(r.g.g, r.trial): r.inliers for r in consensus.votes(rows, 40, 3, float(np.cos(0.02)), chunk).collect()}
    assert {g for g, _ in got} == {"large", "half", "few", "wild", "alike"}
    # fits of rows that are all alike turn about an open axis
    assert all(trials[x] == n for x, n in got.items() if x[0] != "alike")
    for g, (a, _) in groups.items():
        mine = {k: n for (x, k), n in got.items() if x == g}
        if g != "odd" and len(a) < 2 * chunk:
            assert list(mine) == [min(range(40), key=lambda k: (-trials[g, k], k))] or g == "alike"
        elif g != "odd":
            assert len(mine) == 40
    # a query of all groups makes no row of each trial
    monkeypatch.setattr(consensus, "trial_rotations", None)
    assert consensus.robust_rotations(pairs, ["g"], 1.0, 40, 3, chunk=chunk).count() == len(groups)
