"""Summaries and checks of streams and documents."""

import json
import struct

from pyspark.sql import functions as F

from solstice.operators import inspection as I
from solstice.sources import synthetic, trailer


def recording(spark, kind, data):
    return spark.createDataFrame([("a", bytearray(synthetic.recording({kind: data})))], "source string, content binary")


def test_exposures(spark):
    times = [0, 100, 200, 500]
    files = recording(spark, trailer.EXPOSURE, b"".join(struct.pack("<Qd", t, 0.002 * (k + 1)) for k, t in enumerate(times)))
    r = I.exposure_summary(trailer.stream(files, "exposure")).first()
    assert (r.samples, r.median_step, r.gaps, r.not_increasing, r.least, r.largest) == (4, 100.0, 1, 0, 0.002, 0.008) and abs(r.half_range - 0.003) < 1e-12


def test_motion_and_attitude(spark):
    files = recording(spark, trailer.RAW_MOTION, b"".join(struct.pack("<Q6H", 1000 * k, 0 if k == 3 else 5, 1, 2, 3, 4, 5) for k in range(11)))
    r = I.motion_summary(trailer.stream(files, "raw_motion")).first()
    assert (r.samples, r.mean_hz, r.median_hz, r.saturated) == (11, 1000.0, 1000.0, 1)
    files = recording(spark, trailer.ATTITUDE, b"".join(struct.pack("<Q7f", k, 0, 0, 0, 1, 0, 0, 0) for k in (1, 2, 2)))
    r = I.orientation_quality(trailer.stream(files, "attitude")).first()
    assert (r.least, r.largest, r.increasing) == (1.0, 1.0, False)
    assert spark.range(1).select(trailer.scale(F.lit(49152), 2000.0)).first()[0] == 1000.0


def test_probes(spark):
    stream = {"codec_type": "video", "codec_name": "hevc", "width": 64, "height": 64, "r_frame_rate": "30000/1001", "avg_frame_rate": "30000/1001", "nb_frames": "9"}
    documents = {"good": [stream, stream], "one": [stream], "odd": [stream, stream | {"height": 32, "r_frame_rate": "25/1"}], "none": [stream | {"nb_frames": "N/A"}] * 2}
    rows = [(k, json.dumps({"streams": v})) for k, v in documents.items()] + [("broken", "{")]
    found = I.video_violations(I.probe_streams(spark.createDataFrame(rows, "source string, json string"))).collect()
    assert sorted((r.source, r.rule) for r in found) == [("none", "length"), ("odd", "alike"), ("odd", "rate"), ("odd", "square"), ("one", "two streams")]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(I.lens_numbers(F.lit("1_2.5_-3"), 3)) == [1.0, 2.5, -3.0]
    assert value(I.lens_numbers(F.lit("1_x_3"), 3)) is None and value(I.lens_numbers(F.lit("1_2"), 3)) is None
    assert value(I.rational(F.lit("30000/1001"))) == (30000, 1001) and value(I.rational(F.lit("0/0"))) is None
    assert value(I.readout(F.lit("auto"), F.lit(50.0), F.lit(20.0))) == 0.02 and value(I.readout(F.lit("auto"), F.lit(50.0), F.lit(21.0))) is None
    assert value(I.proper_rotation(F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)]))) and not value(I.proper_rotation(F.array(*[F.lit(float(x)) for x in (0, 1, 0, 1, 0, 0, 0, 0, 1)])))
    square = F.from_json(F.lit('[{"x":0,"y":0},{"x":2,"y":0},{"x":2,"y":2},{"x":0,"y":2}]'), "array<struct<x:double,y:double>>")
    assert value(I.polygon_area(square)) == 4.0 and value(I.in_polygon(square, F.lit(1.0), F.lit(1.0))) and not value(I.in_polygon(square, F.lit(3.0), F.lit(1.0)))
    assert value(I.nominal_rate(F.lit(29.97), F.lit(30.0))) and not value(I.nominal_rate(F.lit(25.0), F.lit(30.0)))
    audio = "codec_name string, sample_rate string, channels int, start_time string, duration_ts long"
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([None, ("aac", "48000", 2, "0.0", 9), ("mp3", "48000", 2, "0", 9), ("aac", "44100", 2, "0", 9), ("aac", "48000", 6, "0", 9), ("aac", "48000", 1, "-1", 9)])], f"k int, stream struct<{audio.replace(' ', ':').replace(',:', ',')}>")
    assert [r[0] for r in rows.orderBy("k").select(I.audio_profile(F.col("stream"))).collect()] == ["absent", "ok", "codec", "rate", "channels", "start"]


def test_border_points_belong_to_one_of_two_polygons(spark):
    from pyspark.sql import functions as F

    polygon = lambda corners: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    parts = [[(0, 0), (4, 0), (0, 4)], [(4, 0), (4, 4), (0, 4)], [(4, 0), (8, 0), (8, 4), (4, 4)], [(0, 4), (8, 4), (8, 8), (0, 8)]]  # together a square
    grid = spark.range(17 * 17).select((F.col("id") % 17 / 2.0).alias("x"), (F.floor(F.col("id") / 17) / 2.0).alias("y"))
    rows = grid.select("x", "y", *[I.in_polygon(polygon(p), F.col("x"), F.col("y")).cast("int").alias(f"p{k}") for k, p in enumerate(parts)]).collect()
    assert all(r.p0 + r.p1 + r.p2 + r.p3 == int(r.x < 8 and r.y < 8) for r in rows)
