"""Calibration fits find the truth in made-up recordings, and refuse what they should."""

import numpy as np
import pandas as pd
import pytest

from solstice.functions import lens
from solstice.operators import calibration, gates
from solstice.operators.motion import conjugate, exp_rotation, product

from .test_recurrence import serial

RNG = np.random.default_rng(5)


def wave(t, seed=0):
    """Slow rates about three axes, in radians a second."""
    k = np.array([[0.11, 0.23, 0.37], [0.17, 0.29, 0.41], [0.13, 0.31, 0.19]])
    return np.stack([sum(0.4 * np.sin(2 * np.pi * f * t + seed + 3 * i + j) for j, f in enumerate(row)) for i, row in enumerate(k)], axis=1)


def frame(spark, source, t, v, names="x y z"):
    return spark.createDataFrame(pd.DataFrame({"source": source, "t": t} | {c: v[:, i] for i, c in enumerate(names.split())}))


@pytest.mark.parametrize("f", [0.2, 1.0, 2.0, 5.0])
def test_filter_has_the_gain_of_its_order_and_no_delay(f):
    t = np.arange(4000) / 50
    x = np.stack([np.sin(2 * np.pi * f * t), np.full(len(t), 3.0)], axis=1)
    y = serial(x, 2.0, 50)
    gain = 1 / (1 + (np.tan(np.pi * f / 50) / np.tan(np.pi * 2 / 50)) ** 6)
    assert np.abs(y[1000:3000, 0] - gain * x[1000:3000, 0]).max() < 2e-3
    assert np.abs(y[:, 1] - 3).max() < 1e-9


def gyro_data(spark, source, shift, turn, bias, seconds=100, scale=1.0, noise=0.0):
    t = np.arange(0, seconds, 0.01)
    q = np.arange(5, seconds - 5, 0.1)
    goal = scale * wave(q + shift) @ turn + bias + noise * RNG.normal(size=(len(q), 3))
    return frame(spark, source, t, scale * wave(t)), frame(spark, source, q, goal)


def rotation(v):
    return np.stack([calibration.turned(exp_rotation(np.array(v, float))[None], e[None])[0] for e in np.eye(3)])


def test_gyro_fit_finds_shift_rotation_and_bias(spark):
    turn, bias = rotation([0.4, -0.8, 1.2]), np.array([0.01, -0.02, 0.03])
    raw, target = gyro_data(spark, "a", 0.023, turn, bias)
    fit = calibration.fit_gyro(raw, target)
    row = fit.first()
    assert row.status == "fitted" and abs(row["shift"] - 0.023) < 1e-9 and row.train_rms < 0.01 and row.holdout_rms < 0.01
    assert np.abs(np.array(row.rotation).reshape(3, 3) - turn).max() < 1e-4 and np.abs(np.array(row.bias) - bias).max() < 1e-4
    from pyspark.sql import functions as F

    raw2, target2 = gyro_data(spark, "b", 0.023, turn, bias, 80)
    raw3, target3 = gyro_data(spark, "c", 0.023, turn.T, bias, 80)
    for other, r, t, want in (("b", raw2, target2, "transfers"), ("c", raw3, target3, "rejected")):
        assert calibration.gyro_transfer(fit.withColumn("other", F.lit(other)), r, t).first().status == want


@pytest.mark.parametrize("options, want", [({"seconds": 20}, "few samples"), ({"scale": 0.002}, "little motion"), ({"noise": 0.2}, "hold-out error"), ({"bias": 0.2}, "bias"), ({"shift": 0.5}, "shift at its bound")])
def test_gyro_fits_are_refused(spark, options, want):
    bias = np.array([options.pop("bias", 0.0), 0, 0])
    raw, target = gyro_data(spark, "a", options.pop("shift", 0.0), np.eye(3), bias, **options)
    assert calibration.fit_gyro(raw, target).first().status == want


def track(seconds=30, step=0.02):
    t = np.arange(0, seconds, step)
    q = [np.array([0.0, 0, 0, 1])]
    for w in wave(t[:-1] + step / 2):
        q.append(product(q[-1], exp_rotation(w * step)))
    return t, np.array(q)


def seen_downs(t, q, mount, shift, at):
    world = product(calibration.slerp(t, q, at + shift), np.broadcast_to(exp_rotation(mount), (len(at), 4)))
    return calibration.turned(conjugate(world), np.broadcast_to([0.0, 0, 1], (len(at), 3)))


def test_gravity_fits_find_random_mounts_and_shifts_and_refuse(spark):
    t, q = track(130)
    frames, truth = [], {}
    for k in range(3):
        mount, shift = np.array([0, 0, -np.pi / 2]) + RNG.uniform(-0.5, 0.5, 3), RNG.uniform(-0.3, 0.3)
        truth[f"s{k}"] = mount, shift
        frames.append(frame(spark, f"s{k}", (at := np.sort(RNG.uniform(2, 125, 30))), seen_downs(t, q, mount, shift, at), "dx dy dz"))
    down = seen_downs(t, q, np.array([0.1, 0.2, -1.0]), 0.0, at)
    frames += [frame(spark, "few", at[:5], down[:5], "dx dy dz"), frame(spark, "tilt", at, np.broadcast_to(down[0], down.shape), "dx dy dz"), frame(spark, "coverage", at + 200, down, "dx dy dz")]
    frames.append(frame(spark, "ordered", np.where(np.arange(30) == 4, at[3], at), down, "dx dy dz"))
    seen = frames[0]
    for more in frames[1:]:
        seen = seen.unionByName(more)
    poses = frame(spark, "x", t, q, "qx qy qz qw").drop("source").crossJoin(seen.select("source").distinct()).select("source", "t", "qx", "qy", "qz", "qw")
    fit = calibration.stored(calibration.fit_gravity(seen, poses))
    out = {r.source: r for r in fit.collect()}
    for s in ("few", "tilt", "coverage", "ordered"):
        assert out[s].status == s and out[s].mount is None
    for s, (mount, shift) in truth.items():
        r = out[s]
        apart = product(conjugate(exp_rotation(mount)), exp_rotation(np.array(r.mount)))
        assert r.status == "fitted" and r.samples == 30 and r.rms_degrees < 1e-4 and abs(r["shift"] - shift) < 1e-5 and np.abs(apart[:3]).max() < 1e-5
    scores = {r.source: r for r in calibration.score_gravity(seen, poses, fit.where("status = 'fitted'")).collect()}
    assert scores.keys() == truth.keys() and all(x.status == "scored" and abs(x.rms_degrees - out[s].rms_degrees) < 1e-9 and abs(x.largest_degrees - out[s].largest_degrees) < 1e-9 for s, x in scores.items())
    late = fit.where("source = 's0'").selectExpr("source", "mount", "shift + 20 as shift")
    assert [(x.status, x.rms_degrees) for x in calibration.score_gravity(seen, poses, late).collect()] == [("coverage", None)]


def tracks_of(source, t, q, shift, scale, n=600, noise=0.0, rows=0.5):
    pair = np.arange(n) // 10
    t0 = 1 + pair * (t[-1] - 3) / (n / 10)
    row = RNG.uniform(-rows, rows, (n, 2))
    first = RNG.normal(size=(n, 3))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    at = np.stack([t0, t0 + 0.1], axis=1) + shift + row * 0.02 * scale
    move = product(conjugate(calibration.slerp(t, q, at[:, 1])), calibration.slerp(t, q, at[:, 0]))
    second = calibration.turned(move, first) + noise * RNG.normal(size=(n, 3))
    second /= np.linalg.norm(second, axis=1, keepdims=True)
    return pd.DataFrame({"source": source, "pair": pair, "t0": t0, "t1": t0 + 0.1, "r0": row[:, 0], "r1": row[:, 1]} | {f"{k}{c}": v[:, i] for k, v in (("a", first), ("b", second)) for i, c in enumerate("xyz")})


def test_image_timing_finds_random_shifts_and_scales_and_refuses(spark):
    t, q = track(150)
    truth = {f"s{k}": (RNG.uniform(-0.03, 0.03), RNG.choice([0.7, 1.3]) + RNG.uniform(-0.1, 0.1)) for k in range(2)}
    tables = [tracks_of(s, t, q, *x) for s, x in truth.items()] + [tracks_of("right", t, q, 0.0, 1.0), tracks_of("few", t, q, 0.01, 1.0, n=150), tracks_of("flat", t, q, 0.01, 1.0, rows=0.1), tracks_of("far", t, q, 0.2, 1.0)]
    seen = spark.createDataFrame(pd.concat(tables))
    poses = frame(spark, "x", t, q, "qx qy qz qw").drop("source").crossJoin(seen.select("source").distinct()).select("source", "t", "qx", "qy", "qz", "qw")
    out = {r.source: r for r in calibration.fit_image_timing(seen, poses, 0.02).collect()}
    for s, (shift, scale) in truth.items():
        r = out[s]
        assert r.status == "qualified" and r.reasons == [] and abs(r["shift"] - shift) < 1e-4 and abs(r.scale - scale) < 1e-2 and r.after_median < r.before_median
    assert "hold-out median" in out["right"].reasons and out["few"].reasons == out["flat"].reasons == ["few observations"] and out["few"]["shift"] is None
    assert "at its bounds" in out["far"].reasons and {out[s].status for s in ("right", "few", "flat", "far")} == {"rejected"}


def test_rigid_background_finds_the_turn_and_refuses_a_plane(spark):
    turn = rotation([0.1, 0.2, -0.3])
    a = RNG.normal(size=(60, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a @ turn
    b[:20] = RNG.permutation(b[:20])
    flat = a.copy()
    flat[:, 2] = 0
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    rows = [pd.DataFrame({"pair": k} | {f"{n}{c}": v[:, i] for n, v in (("a", x), ("b", y)) for i, c in enumerate("xyz")}) for k, (x, y) in enumerate([(a, b), (flat, flat @ turn), (a[:11], b[:11])])]
    out = {r.pair: r for r in calibration.rigid_background(spark.createDataFrame(pd.concat(rows)), "pair").collect()}
    assert out[0].status == "fitted" and 40 <= out[0].inliers <= 45 and np.abs(np.array(out[0].rotation).reshape(3, 3) - turn.T).max() < 1e-6
    assert out[1].status == out[2].status == "rejected"


def test_inverse_distortion_and_its_jacobian():
    c = np.array([0.05, -0.02, 0.01, -0.003, 0.001, 0.004, -0.003, 0.002, 0.001, 0.003, -0.002, 0.001, 0.0005])
    points = RNG.uniform(-1, 1, (200, 2))
    moved, slope = lens.distorted13(points, c)
    h = 1e-6
    for k in range(2):
        ahead = lens.distorted13(points + h * np.eye(2)[k], c)[0]
        assert np.abs((ahead - moved) / h - slope[:, :, k]).max() < 1e-4
    back, valid = lens.undistorted13(moved, c)
    assert valid.all() and np.abs(back - points).max() < 1e-9
    folded = np.array([-2.0, *[0.0] * 12])
    assert not lens.undistorted13(np.array([[5.0, 5.0]]), folded)[1].any()
    assert lens.undistorted13(np.zeros((0, 2)), c)[0].shape == (0, 2)


def test_scan_projection_of_a_still_lens_is_the_plain_one(spark):
    from pyspark.sql import functions as F

    one = lens.Lens(1.2, 90.0, 90.0, 63.5, 63.5, 128)
    rays = spark.createDataFrame([(0.1, 0.2, 0.97), (0.3, -0.5, 0.81)], "x double, y double, z double").select(F.struct("x", "y", "z").alias("r"))
    plain = rays.select(lens.project(one, F.col("r.x"), F.col("r.y"), F.col("r.z")).alias("p")).collect()
    assert [r.p for r in lens.project_scan(rays, one, "r", (0.0, 0.0, 0.0), 0.02, "p").collect()] == [r.p for r in plain]
    turned = lens.project_scan(rays, one, "r", (0.0, 0.0, 0.5), 0.02, "p").collect()
    for before, after in zip(plain, turned, strict=True):  # about the optical axis: the angle of the row where it is seen
        a, b = (np.arctan2(p.v - 63.5, p.u - 63.5) for p in (before.p, after.p))
        assert abs((b - a) + 0.5 * 0.02 * (after.p.v / 127 - 0.5)) < 1e-6


def test_gates_refuse_bad_arguments(spark):
    df = spark.range(5).withColumnRenamed("id", "frame")
    assert gates.frame_range(df, 1, None).count() == 4
    for first, count, every in ((-1, 1, 1), (0, 0, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            gates.frame_range(df, first, count, every=every)
    with pytest.raises(ValueError):
        gates.row_times(df, "frame", 0.2)
