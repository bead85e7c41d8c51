"""Recorded positions: contract, segments and the GPX document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .contracts import violations
from .series import Series, track_points


def position_violations(samples: DataFrame) -> DataFrame:
    """(sample, rule) of acquired rows that a recording may not have: other status or hemisphere letters, milliseconds
    of 1000 or more, times after the year 9999, or times that do not increase."""
    acquired = samples.where("fix <> 'V'").withColumn("utc_ms", F.col("utc_s") * 1000 + F.col("ms"))
    before = F.lag("utc_ms").over(W.partitionBy("source").orderBy("sample"))
    checked = acquired.withColumn("_before", before).withColumn("where", F.struct("source", "sample"))
    return violations(
        checked, "where",
        {
            "status or hemisphere": (F.col("fix") == "A") & F.col("ns").isin("N", "S") & F.col("ew").isin("E", "W", "O"),
            "milliseconds": F.col("ms") < 1000,
            "calendar": F.col("utc_ms") < 253_402_300_800_000,
            "increasing time": F.col("_before").isNull() | (F.col("utc_ms") > F.col("_before")),
        },
    ).select("where.source", "where.sample", "rule")


def positions(samples: DataFrame, gap_seconds: float = 10.0) -> DataFrame:
    """The valid points with segment (from 1), utc_ms, utc, signed lat and lon, and elevation, speed and course where they are usable."""
    if not 0 < gap_seconds < float("inf"):
        raise ValueError("the gap must be a positive number of seconds")
    clock = samples.withColumn("utc_ms", F.col("utc_s") * 1000 + F.col("ms"))
    bad = ~(finite(F.col("lat")) & finite(F.col("lon")) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180))
    # Rows are ordered by sample, so a late one is found on its own clock.
    acquired = F.when(F.col("fix") != "V", F.col("utc_ms"))
    upto = W.partitionBy("source").orderBy("sample").rowsBetween(W.unboundedPreceding, 0)
    previous = F.last(acquired, ignorenulls=True).over(W.partitionBy("source").orderBy("sample").rowsBetween(W.unboundedPreceding, -1))
    clock = clock.withColumn("_late", F.coalesce(F.col("utc_ms") - previous > gap_seconds * 1000, F.lit(False)).cast("long"))
    points = track_points(clock, Series("source", "sample", "utc_ms"), F.col("fix") == "V", bad, 1 << 62)
    points = points.withColumn("segment", F.col("segment") + F.sum("_late").over(upto))
    points = points.withColumn("segment", F.dense_rank().over(W.partitionBy("source").orderBy("segment")))
    lat = F.abs("lat") * F.when(F.col("ns") == "S", -1.0).otherwise(1.0)
    lon = F.abs("lon") * F.when(F.col("ew").isin("W", "O"), -1.0).otherwise(1.0)
    course = finite(F.col("course")) & (F.col("course") >= 0) & (F.col("course") < 360)
    clock_text = F.expr("cast(timestampadd(MILLISECOND, utc_ms, TIMESTAMP_NTZ'1970-01-01 00:00:00') as string)")  # whatever the session's time zone
    utc = F.concat(F.translate(F.left(clock_text, F.lit(19)), " ", "T"), F.lit("."), F.lpad(F.pmod("utc_ms", F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))
    return points.select(
        "source", "segment", "sample", "utc_ms", utc.alias("utc"), lat.alias("lat"), F.when(lon == 180, -180.0).otherwise(lon).alias("lon"),
        F.when(finite(F.col("alt")), F.col("alt")).alias("elevation_m"),
        F.when(finite(F.col("speed")) & (F.col("speed") >= 0), F.col("speed")).alias("speed_mps"),
        F.when(course, F.col("course")).alias("course_degrees"),
    )


def position_summary(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Per source: samples, points, segments, void, invalid, omitted values, first and last time."""
    all_rows = samples.groupBy("source").agg(F.count("*").alias("samples"), F.count_if(F.col("fix") == "V").alias("void"))
    omitted = F.sum(sum(F.col(c).isNull().cast("long") for c in ("elevation_m", "speed_mps", "course_degrees")))
    found = points.groupBy("source").agg(
        F.count("*").alias("points"), F.count_distinct("segment").alias("segments"), omitted.alias("omitted"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms")
    )
    out = all_rows.join(found, "source", "left")
    return out.withColumn("invalid", F.col("samples") - F.col("void") - F.coalesce("points", F.lit(0)))


def _fixed(x, digits: int):
    return F.format_string(f"%.{digits}f", x)


def gpx(points: DataFrame) -> DataFrame:
    """(source, document): a GPX 1.1 track per source, a trkseg per segment.

    Segments are assembled first and then joined, each in order. A longitude that rounds to 180 is written as -180.
    """
    lon = _fixed(F.col("lon"), 9)
    lon = F.when(lon == "180.000000000", "-180.000000000").otherwise(lon)
    ele = F.when(F.col("elevation_m").isNotNull(), F.concat(F.lit("<ele>"), _fixed(F.col("elevation_m"), 6), F.lit("</ele>"))).otherwise("")
    more = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{n}>"), _fixed(F.col(c), 6), F.lit(f"</{n}>"))).otherwise("") for c, n in (("speed_mps", "speed"), ("course_degrees", "course"))]
    point = F.concat(F.lit('<trkpt lat="'), _fixed(F.col("lat"), 9), F.lit('" lon="'), lon, F.lit('">'), ele, F.lit("<time>"), F.col("utc"), F.lit("</time><extensions>"), *more, F.lit("</extensions></trkpt>"))

    def ordered(key, text):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("t")))), lambda x: x.t), "")

    segments = points.groupBy("source", "segment").agg(ordered("sample", point).alias("s"), F.min("utc").alias("first"))
    body = segments.groupBy("source").agg(ordered("segment", F.concat(F.lit("<trkseg>"), F.col("s"), F.lit("</trkseg>"))).alias("b"), F.min("first").alias("first"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="solstice"><metadata><time>'
    return body.select("source", F.concat(F.lit(head), "first", F.lit("</time></metadata><trk>"), "b", F.lit("</trk></gpx>")).alias("document"))
