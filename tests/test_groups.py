"""Many small groups and recordings at once, against one at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solstice.operators import groups
from solstice.plans import recording_queries
from solstice.sources import recording_source as rs
from solstice.sources import synthetic, trailer


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_frames_hold_whole_groups_whatever_the_batches(size):
    rng = np.random.default_rng(size)
    key = np.sort(rng.integers(0, 12, 60)).astype(float)
    key[:9] = np.nan
    rows = pd.DataFrame({"a": key, "b": [str(x) for x in np.arange(60) // 11], "k": np.arange(60)})
    got = list(groups.whole((rows.iloc[k : k + size] for k in range(0, 60, size)), ["a", "b"]))
    assert pd.concat(got).k.tolist() == list(range(60))
    ends = [x.iloc[-1].k for x in got]
    assert set(ends[:-1]) <= {k - 1 for k in groups.starts(rows, ["a", "b"])}
    assert len(groups.starts(rows, ["a", "b"])) == len(rows.fillna(-1).groupby(["a", "b"]))


def test_recordings_of_many_users_share_files_and_their_parts_share_tasks(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 900
    (tmp_path / "in").mkdir()
    pq.write_table(
        pa.table({"event_id": range(3 * n), "ts": pa.array([10_000 * k for k in range(3 * n)], pa.timestamp("us")), "user_id": [k % n for k in range(3 * n)], "event_type": ["view"] * 3 * n, "value": [float(k % 9) for k in range(3 * n)], "props": ["{}"] * 3 * n}),
        tmp_path / "in/events.parquet",
    )
    got = recording_queries._scan(spark, str(tmp_path / "in"), "exposure", split_bytes=100)
    made = spark.read.parquet(recording_queries._manifest(spark, str(tmp_path / "in")))
    assert made.count() == n and made.select("path").distinct().count() < 20
    assert got.rdd.getNumPartitions() <= 2 * rs.TASKS
    assert got.count() == 3 * n and recording_queries._user(got).select("user_id", "us").distinct().count() == 3 * n


def test_a_recording_in_a_file_of_many_is_read_by_parts(spark, tmp_path):
    import struct

    one = [synthetic.recording({trailer.EXPOSURE: b"".join(struct.pack("<Qd", 10 * i + k, 0.01) for i in range(50))}) for k in range(3)]
    (tmp_path / "all.bin").write_bytes(b"".join(one))
    rows = [(f"r{k}", len(x), f"file://{tmp_path}/all.bin", sum(map(len, one[:k]))) for k, x in enumerate(one)]
    spark.createDataFrame(rows, "source string, length long, path string, start long").coalesce(1).write.parquet(f"file://{tmp_path}/manifest")
    for split in (128 << 20, 100):
        got = rs.scan(spark, "exposure", manifest=f"file://{tmp_path}/manifest", split_bytes=split, ordered="true").where(F.col("us") >= 100)
        assert sorted((r.source, r["sample"], r.us) for r in got.collect()) == [(f"r{k}", i, 10 * i + k) for k in range(3) for i in range(10, 50)]


def test_filters_of_small_sources_share_calls(spark):
    from solstice.operators import recurrence

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"source": np.repeat(np.arange(300), 25), "t": np.tile(np.arange(25) / 10, 300), "x": rng.normal(size=7500), "y": rng.normal(size=7500), "z": 1.0})
    df = spark.createDataFrame(rows)
    for out in (recurrence.zero_phase_lowpass(df, 0.5), recurrence.fading_state(df, "source", F.floor("t"), ["t"], F.col("x"), F.col("y") > 0, 0.3, 0.6, ["t"])):
        plan = out._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan and "MapInPandas" in plan
        assert out.count() == 7500
    one = recurrence.zero_phase_lowpass(df.where("source = 7"), 0.5).orderBy("t").toPandas()
    some = recurrence.zero_phase_lowpass(df, 0.5).where("source = 7").orderBy("t").toPandas()
    assert np.abs(one[["x", "y", "z"]].to_numpy() - some[["x", "y", "z"]].to_numpy()).max() < 1e-12


def test_orientation_works_out_its_samples_once_and_frames_share_calls(spark):
    from solstice.operators import motion

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    rates = spark.range(2000).select(F.lit(1).alias("source"), (F.col("id") / 1000).alias("t"), told(F.lit(0.1)).alias("wx"), F.lit(0.0).alias("wy"), F.lit(0.0).alias("wz"))
    anchors = spark.range(0, 2000, 100).select(F.lit(1).alias("source"), (F.col("id") / 1000).alias("t"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"))
    frames = spark.range(60).select(F.lit(1).alias("source"), "id", (F.col("id") / 40 + 0.2).alias("centre"), F.lit(0.02).alias("readout"))
    out = motion.row_poses(frames, rates, anchors)
    got = out.collect()
    assert len(got) == 60 * motion.ROW_SAMPLES and {r.status for r in got} == {"ok"}
    assert seen.value <= 2 * 2000
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_piece_works_out_the_turns_between_its_poses_once(monkeypatch):
    from solstice.operators import calibration

    rng = np.random.default_rng(0)
    t, q, at = np.sort(rng.random(50)), rng.normal(size=(50, 4)), rng.uniform(-0.2, 1.2, 400)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    want = calibration.slerp(t, q, np.clip(at, t[0], t[-1]))
    calls, log = [], calibration.log_rotation
    monkeypatch.setattr(calibration, "log_rotation", lambda x: calls.append(len(x)) or log(x))
    part = {"pose_t": t, **{f"pose_q{c}": q[:, k] for k, c in enumerate("xyzw")}}
    for _ in range(3):
        assert np.abs(calibration.posed(part, at) - want).max() < 1e-12
    assert calls == [49]
