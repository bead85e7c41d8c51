"""Segments, interpolation and states on series with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from solstice.functions import quaternion as Q
from solstice.operators import interpolation as I
from solstice.operators import series as S
from solstice.streaming import tracks
from solstice.streaming.replay import replay

SERIES = S.Series()


def table(spark, rows, schema="source long, id long, us long, value double, void boolean, invalid boolean"):
    return spark.createDataFrame(rows, schema)


def test_gap_is_measured_across_void_rows_and_invalid_rows_move_the_clock(spark):
    rows = [(1, 0, 0, 1.0, False, False), (1, 1, 5, 2.0, True, False), (1, 2, 8, 3.0, False, False), (1, 3, 9, 4.0, False, True), (1, 4, 18, 5.0, False, False), (1, 5, 50, 6.0, False, None), (2, 6, 0, 7.0, True, False)]
    out = S.track_segments(table(spark, rows), SERIES, F.col("void"), F.col("invalid"), 10, "value").orderBy("segment_id").collect()
    assert [(r.source, r.segment_id, r.points, r.first_us) for r in out] == [(1, 1, 1, 0), (1, 2, 1, 8), (1, 3, 1, 18), (1, 4, 1, 50)]


def test_stream_gives_the_same_segments(spark, tmp_path):
    rows = [(1, k, 3 * k + (20 if k > 6 else 0), float(k), k == 3, k == 5) for k in range(10)] + [(2, 100, 5, 1.0, False, False)]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = S.track_points(table(spark, rows), SERIES, F.col("void"), F.col("invalid"), 10).groupBy("source", "segment").count()
    stream = replay(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "in"), "*.parquet", lambda s: tracks.segments(s, 10)).where("status = 'ok'").groupBy("source", "segment").count()
    assert sorted(r["count"] for r in batch.collect()) == sorted(r["count"] for r in stream.collect())


def test_empty_series(spark):
    empty = table(spark, [])
    assert S.track_segments(empty, SERIES, F.col("void"), F.col("invalid"), 10, "value").count() == 0
    assert S.cadence(empty, SERIES).count() == 0
    assert S.ema(empty, SERIES, F.col("value"), F.lit(True), 0.5, 0.5).count() == 0


def test_sign_resets_at_a_zero_product(spark):
    rows = spark.createDataFrame([(1, k, k, d) for k, d in enumerate([None, -1.0, 1.0, 0.0, -1.0])], "source long, id long, us long, d double")
    out = S.sign_flips(rows, SERIES, F.col("d")).orderBy("id").collect()
    assert [r["sign"] for r in out] == [1, -1, -1, 1, -1]


def test_state_starts_decays_and_is_limited(spark):
    rows = table(spark, [(1, 0, 0, 9.0, True, False), (1, 1, 1, 1.0, False, False), (1, 2, 2, 5.0, False, False), (1, 3, 3, 0.0, True, False)])
    out = [r.state for r in S.ema(rows, SERIES, F.col("value"), ~F.col("void"), 0.5, 0.5, 1.0).orderBy("id").collect()]
    assert out == [None, 1.0, 2.0, 1.0]


def test_interpolation_is_guarded(spark):
    samples = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 10, 10.0), (1, 2, 1000, 0.0)], "source long, id long, us long, value double")
    queries = spark.createDataFrame([(1, k, t) for k, t in enumerate([-1, 0, 5, 10, 500, 1000, 1001])], "source long, id long, us long")
    out = I.asof(queries, samples).withColumn("s", I.outcome(100)).withColumn("v", I.linear("value")).withColumn("c", I.linear("value", clamp=True)).orderBy("us").collect()
    assert [r.s for r in out] == ["outside", "ok", "ok", "ok", "gap", "ok", "outside"]
    assert [r.v for r in out][:4] == [None, 0.0, 5.0, 10.0] and out[6].v is None
    assert (out[0].c, out[6].c) == (0.0, 0.0)


def test_slerp_halves_a_turn_on_the_shorter_arc(spark):
    q = lambda a: {"x": 0.0, "y": 0.0, "z": math.sin(a / 2), "w": math.cos(a / 2)}
    minus = {k: -v for k, v in q(1.0).items()}
    samples = spark.createDataFrame([(1, 0, 0, q(0.0)), (1, 1, 10, minus)], "source long, id long, us long, q struct<x:double,y:double,z:double,w:double>")
    out = I.slerped(I.asof(spark.createDataFrame([(1, 0, 5), (1, 1, 10), (1, 2, 11)], "source long, id long, us long"), samples)).orderBy("us").collect()
    assert out[0].r.z == pytest.approx(math.sin(0.25)) and abs(out[1].r.z) == pytest.approx(math.sin(0.5)) and out[2].r is None
    v = spark.range(1).select(Q.rotation_vector(Q.about_axis("z", F.lit(0.7))).alias("v")).first().v
    assert v.z == pytest.approx(0.7)


def test_span_limits_only_steps_that_touch_it(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([0, 10, 20, 100, 110])], "source long, id long, us long")
    assert S.span_gaps(rows, SERIES, 11, 19, 15).first().over_limit == 0
    assert S.span_gaps(rows, SERIES, 11, 30, 15).first().over_limit == 1
    assert S.span_gaps(rows, SERIES, 11, 300, 15).count() == 0
