"""Operators on frames as relations: flow fields with their trust, gains, picture statistics, and rotations from matched features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import finite, smoothstep
from .consensus import robust_rotations
from .neighbours import nearest_two


def flow_trust(forward: DataFrame, backward: DataFrame, width: int, pixel_x: float, pixel_y: float, most_degrees: float = 2.0) -> DataFrame:
    """forward (frame, row, col, fx, fy, texture, valid) with back_x, back_y, trust: 0 where the flow is not to be believed.

    The backward flow is read where the forward one ends, between pixels, around the ring of columns. Trust falls from 1 at a round trip that misses by half a pixel to 0 at
    one and a half, and with the texture; it is 0 for flows that are not finite, end outside the rows, among pixels that are not valid, or move by `most_degrees` or more.
    pixel_x, pixel_y: radians of a pixel.
    """
    key = ["frame", "row", "col"]
    good = finite(F.col("fx")) & finite(F.col("fy")) & F.col("valid")
    rows = forward.where(good).withColumns({"_x": F.col("col") + F.col("fx"), "_y": F.col("row") + F.col("fy")})
    x0, y0 = F.floor("_x"), F.floor("_y")
    u, v = F.col("_x") - x0, F.col("_y") - y0
    corner = lambda dx, dy, w: F.struct(F.pmod(x0 + dx, F.lit(width)).cast("int").alias("c"), (y0 + dy).cast("int").alias("r"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - u) * (1 - v)), corner(1, 0, u * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 1, u * v))
    ends = rows.select(*key, F.explode(corners).alias("p")).select(*key, F.col("p.c").alias("_c"), F.col("p.r").alias("_r"), F.col("p.w").alias("_w"))
    other = backward.where(finite(F.col("fx")) & finite(F.col("fy")) & F.col("valid")).select("frame", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("fx").alias("_bx"), F.col("fy").alias("_by"))
    back = ends.join(other, ["frame", "_r", "_c"]).groupBy(*key).agg(F.sum(F.col("_w") * F.col("_bx")).alias("back_x"), F.sum(F.col("_w") * F.col("_by")).alias("back_y"), F.sum("_w").alias("_covered"))
    out = forward.join(back, key, "left")
    error = F.sqrt((F.col("fx") + F.col("back_x")) ** 2 + (F.col("fy") + F.col("back_y")) ** 2)
    moved = F.sqrt((F.col("fx") * pixel_x) ** 2 + (F.col("fy") * pixel_y) ** 2)
    supported = good & (F.col("_covered") > 0.99) & (moved < math.radians(most_degrees))
    trust = smoothstep(1.5 - error) * smoothstep((F.col("texture") - 1) / 12)
    return out.withColumn("trust", F.when(F.coalesce(supported, F.lit(False)), trust).otherwise(0.0)).drop("_covered")


def displacement(alpha: Column, trust: Column) -> tuple[Column, Column]:
    """How far along their flows the first and the second picture are read, where alpha is the first's weight."""
    return (1 - alpha) * trust, alpha * trust


def gains(log_ratio: Column) -> tuple[Column, Column]:
    """Factors of both pictures that balance them: the brighter one gets darker, none brighter."""
    return F.exp(F.least(log_ratio, F.lit(0.0))), F.exp(F.least(-log_ratio, F.lit(0.0)))


def picture_statistics(pixels: DataFrame, *group: str) -> DataFrame:
    """Per picture: mean of the value by 255, and the variance (of all pixels) of the Laplacian; at an edge the pixel inside counts for the one outside."""
    across, down = W.partitionBy(*group, "row").orderBy("col"), W.partitionBy(*group, "col").orderBy("row")
    sides = []
    for w in (across, down):
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        sides += [F.coalesce(before, after, F.col("value")), F.coalesce(after, before, F.col("value"))]
    laplacian = sides[0] + sides[1] + sides[2] + sides[3] - 4 * F.col("value")
    return pixels.withColumn("_l", laplacian).groupBy(*group).agg((F.avg("value") / 255).alias("luminance"), F.var_pop("_l").alias("detail"))


def matched_rotations(queries: DataFrame, base: DataFrame, block: str, item: str, descriptor: str, degrees: float = 1.5, iterations: int = 3000, least: int = 12, ratio: float = 0.72) -> DataFrame:
    """Per block (a frame pair): the robust rotation that takes the rays (x, y, z) of the queries to those of the base features they match; see consensus.robust_rotations().

    A query matches its nearest descriptor if that is under `ratio` times as far as the second. A feature without a valid ray has null x.
    """
    near = nearest_two(queries.where("x is not null"), base, block, item, item, descriptor, ratio).where("kept")
    a = queries.select(block, F.col(item).alias("query_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = base.where("x is not null").select(block, F.col(item).alias("base_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    pairs = near.select(block, "query_id", "base_id").join(a, [block, "query_id"]).join(b, [block, "base_id"])
    return robust_rotations(pairs.drop("query_id", "base_id"), block, degrees, iterations, least=least)


def face_observations(fits: DataFrame, tracks: DataFrame, group: str) -> DataFrame:
    """Per frame pair: tracks of each face, and if the background fit (of calibration.rigid_background()) holds, its inliers, p95 and unmatched part; else status `unmeasured`.

    tracks: group, face.
    """
    faces = tracks.groupBy(group, "face").agg(F.count("*").alias("n")).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("face", "n")))).alias("tracks_per_face"))
    fitted = F.col("status") == "fitted"
    keep = lambda x: F.when(fitted, x)
    out = faces.join(fits, group, "left")
    return out.select(
        group, "tracks_per_face", F.when(fitted, "measured").otherwise("unmeasured").alias("status"), keep(F.col("inliers")).alias("inliers"), keep(F.col("p95_degrees")).alias("p95_degrees"),
        keep(1 - F.col("inliers") / F.col("tracks")).alias("unmatched"),
    )
