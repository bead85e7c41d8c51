"""As-of joins and interpolation between samples.

The queries and the samples of a source are one ordered stream: a union, one
shuffle by source, and two running windows (last sample so far, next sample
from here). No row is compared with another source's, and nothing is bucketed by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quaternion as Q


def asof(queries: DataFrame, samples: DataFrame, source: str = "source", time: str = "us", order: str = "id", backward_only: bool = False) -> DataFrame:
    """Each query with `before` (the last sample at or before its time) and `after` (the first one behind `before`).

    Both are structs of the sample's columns, null if there is none. Of samples with
    one time the last by order is meant. Query columns keep their names.
    """
    rest = [c for c in samples.columns if c != source]
    item = F.struct(*[F.col(c) for c in rest])
    left = queries.select(source, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col(order).cast("long").alias("_o"), F.struct("*").alias("_query"), F.lit(None).cast(samples.select(item.alias("x")).schema["x"].dataType).alias("_sample"))
    right = samples.select(source, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_o"), F.lit(None).cast(left.schema["_query"].dataType).alias("_query"), item.alias("_sample"))
    window = W.partitionBy(source).orderBy("_t", "_kind", "_o")
    both = left.unionByName(right)
    both = both.withColumn("before", F.last("_sample", ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0)))
    if not backward_only:
        back = W.partitionBy(source).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_o"))  # from the end, so the frame runs too
        both = both.withColumn("after", F.last("_sample", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    out = both.where("_kind = 1")
    return out.select("_query.*", *(["before"] if backward_only else ["before", "after"]))


def fraction(time: str = "us") -> Column:
    """How far the query is from `before` to `after`, 0 to 1; 0 on the last sample."""
    width = F.col(f"after.{time}") - F.col(f"before.{time}")
    return F.when(F.col(f"before.{time}") == F.col(time), F.lit(0.0)).otherwise((F.col(time) - F.col(f"before.{time}")) / F.nullif(width, F.lit(0)))


def linear(field: str, time: str = "us", clamp: bool = False) -> Column:
    """The field between the samples of asof(); outside them null, or with clamp the nearest sample's."""
    a, b = F.col(f"before.{field}"), F.col(f"after.{field}")
    on = F.col(f"before.{time}") == F.col(time)
    inside = F.when(on, a).when(F.col("before").isNotNull() & F.col("after").isNotNull(), a + (b - a) * fraction(time))
    return F.coalesce(inside, a, b) if clamp else inside


def outcome(limit_us: int, exact_us: int = 0, time: str = "us") -> Column:
    """`outside`, `gap` or `ok`: whether the query may be interpolated.

    A query within exact_us of a sample is ok however far its other neighbour is.
    """
    t, a, b = F.col(time), F.col(f"before.{time}"), F.col(f"after.{time}")
    exact = F.coalesce(t - a <= exact_us, F.lit(False)) | F.coalesce(b - t <= exact_us, F.lit(False))
    return (
        F.when(a.isNull() | (b.isNull() & (a != t)), "outside")
        .when(exact, "ok")
        .when(b - a > limit_us, "gap")
        .otherwise("ok")
    )


def slerped(df: DataFrame, field: str = "q", out: str = "r", time: str = "us") -> DataFrame:
    """Adds the orientation between the samples of asof(); null outside them.

    In steps of their own columns: as one expression the generated code would outgrow a method.
    """
    a, b = F.col(f"before.{field}"), F.coalesce(F.col(f"after.{field}"), F.when(F.col(f"before.{time}") == F.col(time), F.col(f"before.{field}")))
    ends = {f"_a{c}": a[c] for c in "xyzw"} | {f"_b{c}": b[c] for c in "xyzw"}
    df = df.withColumns(ends | {"_t": F.coalesce(fraction(time), F.lit(0.0))})
    df = df.withColumn("_dot", sum((F.col(f"_a{c}") * F.col(f"_b{c}") for c in "yzw"), F.col("_ax") * F.col("_bx")))
    df = df.withColumns(dict(zip(("_ka", "_kb"), Q.slerp_weights(F.col("_dot"), F.col("_t")), strict=True)))
    df = df.withColumns({f"_p{c}": F.col("_ka") * F.col(f"_a{c}") + F.col("_kb") * F.col(f"_b{c}") for c in "xyzw"})
    length = F.sqrt(sum((F.col(f"_p{c}") * F.col(f"_p{c}") for c in "yzw"), F.col("_px") * F.col("_px")))
    df = df.withColumn("_n", length)
    made = Q.quaternion(*[F.col(f"_p{c}") / F.col("_n") for c in "xyzw"])
    return df.withColumn(out, F.when(F.col("_n").isNotNull(), made)).drop(*ends, "_t", "_dot", "_ka", "_kb", "_n", *[f"_p{c}" for c in "xyzw"])


def periodic_linear(queries: DataFrame, knots: DataFrame, at: str, value: str, period: float, source: str = "source", order: str = "id") -> DataFrame:
    """queries with the value between the knots (source, at, value) around a ring of `period`: behind the last knot comes the first again. Null without knots.

    Positions count modulo the period. Of knots of one position the mean counts. Only two knots of a source are repeated beyond the ring's ends.
    """
    place = F.pmod(F.col(at).cast("double"), F.lit(float(period)))
    ring = knots.select(source, place.alias("_at"), F.col(value).cast("double").alias("_value")).groupBy(source, "_at").agg(F.avg("_value").alias("_value"))
    ends = ring.groupBy(source).agg(F.min(F.struct("_at", "_value")).alias("a"), F.max(F.struct("_at", "_value")).alias("z"))
    beyond = ends.select(source, F.explode(F.array(*[F.struct((F.col(f"{k}._at") + shift).alias("_at"), F.col(f"{k}._value").alias("_value")) for k, shift in (("a", period), ("z", -period))])).alias("x"))
    ring = ring.unionByName(beyond.select(source, "x._at", "x._value")).withColumn(order, F.lit(0))
    met = asof(queries.withColumn("_at", place), ring, source, "_at", order)
    return met.withColumn(value, linear("_value", "_at")).drop("_at", "before", "after")


def wrap_columns(cells: DataFrame, column: str, width: int, pad: int) -> DataFrame:
    """cells (columns 0 to width - 1 of a ring) with `pad` columns more on either side: those of the other end, under numbers that go on beyond 0 and width - 1."""
    if not 0 <= pad <= width:
        raise ValueError("a ring can be padded by its own width at most")
    c = F.col(column)
    places = F.array_compact(F.array(c, F.when(c < pad, c + width), F.when(c >= width - pad, c - width)))
    rest = [x for x in cells.columns if x != column]
    return cells.select(*rest, F.explode(places).alias(column)).select(*cells.columns)
