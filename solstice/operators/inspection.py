"""Summaries and checks of decoded streams and of documents about recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import finite, within_relative
from .contracts import violations

#: What a media probe prints of each stream, as text.
PROBE = "codec_type string, codec_name string, index int, width int, height int, pix_fmt string, color_range string, color_space string, r_frame_rate string, avg_frame_rate string, nb_frames string, start_time string, sample_rate string, channels int, duration_ts long"


def exposure_summary(exposures: DataFrame) -> DataFrame:
    """Per source: samples, first and last clock, median step, steps of more than twice the median, and least, median, p95, largest and half range of the times."""
    step = F.col("us") - F.lag("us").over(W.partitionBy("source").orderBy("sample"))
    rows = exposures.withColumn("step", step)
    out = rows.groupBy("source").agg(
        F.count("*").alias("samples"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.percentile("step", F.lit(0.5)).alias("median_step"), F.count_if(F.col("step") <= 0).alias("not_increasing"),
        F.min("seconds").alias("least"), F.percentile("seconds", F.lit(0.5)).alias("median"), F.percentile("seconds", F.lit(0.95)).alias("p95"), F.max("seconds").alias("largest"),
    )
    gaps = rows.join(out.select("source", "median_step"), "source").groupBy("source").agg(F.count_if(F.col("step") > 2 * F.col("median_step")).alias("gaps"))
    return out.join(gaps, "source").withColumn("half_range", (F.col("largest") - F.col("least")) / 2)


def motion_summary(samples: DataFrame) -> DataFrame:
    """Per source: samples, mean and median rate in Hz, largest step, and saturated counts."""
    step = F.col("us") - F.lag("us").over(W.partitionBy("source").orderBy("sample"))
    edge = F.exists(F.array(*[F.col(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")]), lambda x: (x == 0) | (x == 65535))
    rows = samples.withColumn("step", step).withColumn("edge", edge)
    mean = (F.count("*") - 1) * 1e6 / F.nullif(F.max("us") - F.min("us"), F.lit(0))
    return rows.groupBy("source").agg(F.count("*").alias("samples"), mean.alias("mean_hz"), (1e6 / F.percentile("step", F.lit(0.5))).alias("median_hz"), F.max("step").alias("largest_step"), F.count_if("edge").alias("saturated"))


def orientation_quality(attitude: DataFrame) -> DataFrame:
    """Per source: least and largest length of the quaternions, and whether the clock increases."""
    length = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2)
    later = F.col("us") > F.lag("us").over(W.partitionBy("source").orderBy("sample"))
    rows = attitude.withColumns({"length": length, "later": F.coalesce(later, F.lit(True))})
    return rows.groupBy("source").agg(F.min("length").alias("least"), F.max("length").alias("largest"), F.bool_and("later").alias("increasing"))


def probe_streams(documents: DataFrame) -> DataFrame:
    """(source, stream): the streams of probe documents (source, json); broken JSON gives none."""
    return documents.select("source", F.explode(F.from_json("json", f"streams array<struct<{PROBE.replace(' ', ':').replace(',:', ',')}>>").streams).alias("stream"))


def rational(text: Column) -> Column:
    """struct<num,den> of `num/den`; null if it is none or a part is not a positive whole number."""
    part = F.split(text, "/")
    num, den = part.getItem(0).try_cast("long"), F.get(part, F.lit(1)).try_cast("long")
    return F.when((F.size(part) == 2) & (num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def video_violations(streams: DataFrame) -> DataFrame:
    """(source, rule): two video streams of one codec, size, rate and length; square, 32 to 8192 wide, at most 120 frames a second."""
    video = streams.where("stream.codec_type = 'video'").select("source", "stream.*")
    rate = rational(F.col("avg_frame_rate"))
    of = video.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("codec_name", "width", "height", "r_frame_rate", "nb_frames").alias("kinds"),
        F.bool_and((F.col("width") == F.col("height")) & F.col("width").between(32, 8192)).alias("square"),
        F.bool_and(F.col("codec_name").isin("h264", "hevc")).alias("codec"), F.bool_and((F.col("r_frame_rate") == F.col("avg_frame_rate")) & (rate.num <= 120 * rate.den)).alias("rate"), F.bool_and(F.col("nb_frames").try_cast("long") > 0).alias("length"),
    )
    return violations(of, "source", {"two streams": F.col("n") == 2, "alike": F.col("kinds") == 1, "square": F.col("square"), "codec": F.col("codec"), "rate": F.col("rate"), "length": F.col("length")})


def nominal_rate(fps: Column, nominal: Column) -> Column:
    """Whether a rate is within 0.11 % of the declared one."""
    return within_relative(fps, nominal, 0.0011)


def readout(policy: Column, fps: Column, milliseconds: Column) -> Column:
    """Seconds of row readout: 0 if off; the recorded time, from 0 to a frame's, if auto; else null."""
    return F.when(policy == "off", 0.0).when((policy == "auto") & finite(milliseconds) & milliseconds.between(0, 1000 / fps), milliseconds / 1000)


def lens_numbers(text: Column, count: int) -> Column:
    """array<double> of `count` finite numbers joined by `_`, else null."""
    numbers = F.transform(F.split(text, "_"), lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) == count) & F.forall(numbers, finite), numbers)


def proper_rotation(m: Column, tolerance: float = 1e-5) -> Column:
    """Whether nine numbers, row by row, are a rotation: orthonormal rows and determinant 1."""
    at = lambda i, j: F.get(m, F.lit(3 * i + j))
    good = F.size(m) == 9
    for i in range(3):
        for j in range(i, 3):
            good = good & (F.abs(sum((at(i, k) * at(j, k) for k in range(1, 3)), at(i, 0) * at(j, 0)) - (1.0 if i == j else 0.0)) <= tolerance)
    det = at(0, 0) * (at(1, 1) * at(2, 2) - at(1, 2) * at(2, 1)) - at(0, 1) * (at(1, 0) * at(2, 2) - at(1, 2) * at(2, 0)) + at(0, 2) * (at(1, 0) * at(2, 1) - at(1, 1) * at(2, 0))
    return F.coalesce(good & (F.abs(det - 1) <= tolerance), F.lit(False))


def _edges(polygon: Column) -> Column:
    """Each corner with the one behind it; polygon: array<struct<x,y>>."""
    turned = F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, F.lit(1), F.lit(1)))
    return F.zip_with(polygon, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygon_area(polygon: Column) -> Column:
    return F.abs(F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside, by crossings of the ray to the right.

    Of the border, points belong to the polygon that lies to their right, or above them where an edge is level; so of polygons that share an edge each point is in one.
    """
    crosses = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < e.a.x + (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x))
    return F.aggregate(_edges(polygon), F.lit(0), lambda s, e: s + F.coalesce(crosses(e), F.lit(False)).cast("int")) % 2 == 1


def audio_profile(stream: Column) -> Column:
    """`absent`, `ok`, or what is wrong with an audio stream (null: none): AAC of 48 kHz with one or two channels that does not start early."""
    rate, start = stream.sample_rate.try_cast("long"), stream.start_time.try_cast("double")
    return (
        F.when(stream.isNull(), "absent").when(stream.codec_name != "aac", "codec").when(rate != 48000, "rate").when(~stream.channels.isin(1, 2), "channels")
        .when(start < 0, "start").when(F.coalesce(stream.duration_ts, F.lit(0)) <= 0, "length").otherwise("ok")
    )


def report(inventory: DataFrame, fields: DataFrame, exposures: DataFrame, motion: DataFrame, attitude: DataFrame, positions: DataFrame, names: dict[int, str]) -> DataFrame:
    """Per source one row: its records (with their hashes, if known), its named metadata, what exposure_summary(), motion_summary(), orientation_quality() and gps.position_summary() say, its problems, and a fingerprint of all that.

    A stream that a recording lacks is null; a problem is named after its stream.
    """
    from .gates import named_fields

    of = [c for c in ("kind", "size", "sha256") if c in inventory.columns]
    records = inventory.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(*of))).alias("records"))
    out = records.join(named_fields(fields, names), "source", "left")
    for name, part in (("exposure", exposures), ("motion", motion), ("attitude", attitude), ("positions", positions)):
        out = out.join(part.select("source", F.struct(*[c for c in part.columns if c != "source"]).alias(name)), "source", "left")
    problems = {"exposure clock": F.col("exposure.not_increasing") > 0, "motion saturated": F.col("motion.saturated") > 0, "attitude clock": ~F.col("attitude.increasing"), "no positions": F.coalesce("positions.points", F.lit(0)) == 0}
    out = out.withColumn("problems", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in problems.items()])))
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*[c for c in out.columns if c != "source"])).cast("binary"), 256))
