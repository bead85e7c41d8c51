"""Blocked filters and states against serial loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solstice.operators import recurrence

SAMPLES = "source string, t double, x double, y double, z double"


def serial(x, cutoff, rate, edge=12):
    """Forward and backward by the difference equation, one number at a time."""
    b, a = recurrence.butterworth3(cutoff, rate)
    settled = [sum(b[i] - a[i] for i in range(k, 4)) for k in (1, 2, 3)]
    out = []
    for column in x.T:
        v = [*(2 * column[0] - column[edge:0:-1]), *column, *(2 * column[-1] - column[-2 : -edge - 2 : -1])]
        for _ in range(2):
            s = [k * v[0] for k in settled]
            y = []
            for u in v:
                w = b[0] * u + s[0]
                s = [b[1] * u - a[1] * w + s[1], b[2] * u - a[2] * w + s[2], b[3] * u - a[3] * w]
                y.append(w)
            v = y[::-1]
        out.append(v[edge:-edge])
    return np.array(out).T


def test_filter_over_blocks_equals_the_difference_equation():
    rng = np.random.default_rng(2)
    low = recurrence.Filter(1.5, 60)
    b, a = recurrence.butterworth3(1.5, 60)
    for n in (0, 1, 127, 128, 129, 700):
        x, state = rng.normal(size=(n, 2)), rng.normal(size=(3, 2))
        s, want = state.copy(), []
        for row in x:
            y = b[0] * row + s[0]
            s = np.stack([b[1] * row - a[1] * y + s[1], b[2] * row - a[2] * y + s[2], b[3] * row - a[3] * y])
            want.append(y)
        got, end = low.over(x, state)
        assert np.abs(end - s).max() < 1e-11 and (not n or np.abs(got - np.array(want)).max() < 1e-11)
        assert np.abs(low.after(n) @ state - low.over(np.zeros((n, 2)), state)[1]).max() < 1e-11


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(14)
    out = {}
    for name, n, rate in (("long", 5000, 200), ("short", 12, 100), ("thirteen", 13, 100), ("slow", 300, 3.5), ("mid", 640, 50)):
        t = np.cumsum(rng.choice([1, 1, 1, 0.9, 1.1], n)) / rate
        out[name] = t, np.cumsum(rng.normal(size=(n, 3)), axis=0)
    out["still"] = np.full(40, 7.0), rng.normal(size=(40, 3))
    return out


@pytest.mark.parametrize("chunk", [32, 500, 1 << 16])
def test_lowpass_equals_the_serial_filter(spark, recordings, chunk):
    rows = pd.concat([pd.DataFrame({"source": s, "t": t, "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}) for s, (t, v) in recordings.items()]).sample(frac=1, random_state=1)
    got = recurrence.zero_phase_lowpass(spark.createDataFrame(rows, SAMPLES), 2.0, bucket=1.7, chunk=chunk).toPandas()
    assert len(got) == len(rows)
    for s, (t, v) in recordings.items():
        mine = got[got.source == s].sort_values("t", kind="stable")
        want = {"short": "short", "slow": "rate", "still": "rate"}.get(s, "ok")
        assert set(mine.status) == {want}
        if want == "ok":
            rate = 1e6 / np.median(np.round(np.diff(t) * 1e6))
            assert np.abs(mine[["x", "y", "z"]].to_numpy() - serial(v, 2.0, rate)).max() < 1e-9 * np.abs(v).max()
        else:
            assert mine[["x", "y", "z"]].isna().all().all()


def test_a_source_is_many_chunks(spark, recordings):
    t, v = recordings["long"]
    rows = spark.createDataFrame(pd.DataFrame({"source": "long", "t": t, "x": v[:, 0]}), "source string, t double, x double")
    out = recurrence.numbered(rows, "source", F.floor(F.col("t") / 3), ["t"], 400).toPandas().sort_values("t")
    assert list(out.k) == list(range(5000)) and set(out.n) == {5000} and sorted(set(out.chunk)) == list(range(12))
    assert out.groupby("chunk").size().tolist() == [400] * 11 + [600]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fading_state_equals_a_loop(spark, chunk):
    rng = np.random.default_rng(6)
    rows = [(s, int(k), float(rng.normal()) if rng.random() > 0.1 else None, bool(rng.random() > p) if rng.random() > 0.05 else None) for s, n, p in (("a", 200, 0.4), ("b", 90, 0.97), ("c", 1, 0.0), ("d", 30, 1.0)) for k in rng.permutation(n)]
    df = spark.createDataFrame(rows, "source string, k0 long, v double, ok boolean")
    got = recurrence.fading_state(df, "source", F.floor(F.col("k0") / 13), ["k0"], F.col("v"), F.col("ok"), 0.3, 0.8, ["k0"], chunk)
    got = {(r.source, r.k0): r.state for r in got.collect()}
    assert len(got) == len(rows)
    state = {}
    for s, k, v, ok in sorted(rows, key=lambda r: r[:2]):
        last = state.get(s)
        if ok and v is not None:
            last = v if last is None else last + 0.3 * (v - last)
        elif last is not None:
            last *= 0.8
        state[s] = last
        assert got[s, k] == (None if last is None else pytest.approx(last, abs=1e-12))


def test_nothing_to_filter(spark):
    assert recurrence.zero_phase_lowpass(spark.createDataFrame([], SAMPLES)).count() == 0
