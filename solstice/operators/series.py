"""Operators over time series: one series per source, ordered by time and a tie-break.

All are windows over (source): Spark sorts each source's rows once in a shuffle
that consecutive operators on the same keys share.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Which columns are the source, the clock (whole microseconds) and the tie-break."""

    source: str = "source"
    time: str = "us"
    order: str = "id"

    @property
    def window(self):
        return W.partitionBy(self.source).orderBy(self.time, self.order)

    @property
    def before(self):
        return self.window.rowsBetween(W.unboundedPreceding, -1)

    @property
    def upto(self):
        return self.window.rowsBetween(W.unboundedPreceding, 0)

    @property
    def onward(self):
        return self.window.rowsBetween(0, W.unboundedFollowing)


def lagged_difference(s: Series, value: str) -> Column:
    return F.col(value) - F.lag(value).over(s.window)


def track_points(df: DataFrame, s: Series, void: Column, invalid: Column, gap_us: int) -> DataFrame:
    """The valid rows with `segment`, a number that grows with each break in the track.

    A void row breaks the track and does not move the clock; an acquired row breaks it
    if it comes more than gap_us after the last acquired one; an acquired row
    with an invalid position moves the clock and then breaks the track. Gaps are so
    measured across void rows. Null conditions count as false.
    """
    void, invalid = F.coalesce(void, F.lit(False)), F.coalesce(invalid, F.lit(False))
    last = F.last(F.when(~F.col("_void"), F.col(s.time)), ignorenulls=True).over(s.before)
    marked = df.withColumns({"_void": void, "_invalid": invalid}).withColumn("_last", last)
    broken = F.col("_void") | F.col("_invalid") | F.coalesce(F.col(s.time) - F.col("_last") > gap_us, F.lit(False))
    marked = marked.withColumn("segment", F.sum(broken.cast("long")).over(s.upto))
    return marked.where(~F.col("_void") & ~F.col("_invalid")).drop("_void", "_invalid", "_last")


def track_segments(df: DataFrame, s: Series, void: Column, invalid: Column, gap_us: int, value: str) -> DataFrame:
    """One row per non-empty segment, numbered from 1 in each source."""
    points = track_points(df, s, void, invalid, gap_us)
    rows = points.groupBy(s.source, "segment").agg(
        F.count("*").alias("points"), F.min(s.time).alias("first_us"), F.max(s.time).alias("last_us"), F.min(value).alias("min_value"), F.max(value).alias("max_value")
    )
    number = F.row_number().over(W.partitionBy(s.source).orderBy("segment"))
    return rows.select(
        s.source, number.cast("long").alias("segment_id"), "points", "first_us", "last_us",
        ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("duration_s"), "min_value", "max_value",
    )


def cadence(df: DataFrame, s: Series) -> DataFrame:
    """Per source: number of steps, median, p95 and largest step, and steps of more than twice the median."""
    steps = df.withColumn("dt", lagged_difference(s, s.time)).where("dt is not null")
    middle = steps.groupBy(s.source).agg(
        F.count("*").alias("steps"), F.percentile("dt", F.lit(0.5)).alias("median_dt"), F.percentile("dt", F.lit(0.95)).alias("p95_dt"), F.max("dt").alias("max_dt")
    )
    gaps = steps.join(middle.select(s.source, "median_dt"), s.source).groupBy(s.source).agg(F.count_if(F.col("dt") > 2 * F.col("median_dt")).alias("gaps"))
    return middle.join(gaps, s.source)


def span_gaps(df: DataFrame, s: Series, start_us: int, end_us: int, limit_us: int) -> DataFrame:
    """Per source that covers the span: the steps that touch it, the largest, and those above the limit.

    A step touches the span if it ends after its start and begins before its end; others may be as long as they like.
    """
    steps = df.withColumn("previous", F.lag(s.time).over(s.window))
    near = steps.where((F.col(s.time) > start_us) & (F.col("previous") < end_us))
    step = F.col(s.time) - F.col("previous")
    out = near.groupBy(s.source).agg(F.count("*").alias("steps"), F.max(step).alias("max_us"), F.count_if(step > limit_us).alias("over_limit"), F.min("previous").alias("_a"), F.max(s.time).alias("_b"))
    return out.where((F.col("_a") <= start_us) & (F.col("_b") >= end_us)).drop("_a", "_b")


def sign_flips(df: DataFrame, s: Series, dot: Column) -> DataFrame:
    """Adds `sign`, 1 or -1, by which a quaternion is multiplied to stay on its predecessor's side.

    dot: the product of the row's raw quaternion and the one before it. Signs change at
    negative products, so their parity decides; a product of exactly 0 starts anew at 1.
    """
    part = W.partitionBy(s.source, "_run").orderBy(s.time, s.order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_dot", dot).withColumn("_run", F.count_if(F.col("_dot") == 0).over(s.upto))
    negative = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(part)
    return out.withColumn("sign", F.when(negative % 2 == 0, 1).otherwise(-1)).drop("_dot", "_run")


def alternating_blocks(t_us: Column, seconds: int = 10) -> Column:
    """Whether the time is in a training block; blocks of so many seconds take turns, training first."""
    return F.pmod(F.floor(t_us / F.lit(seconds * 1_000_000)), F.lit(2)) == 0


def contiguous_blocks(df: DataFrame, source: str, group: str, blocks: int = 4) -> DataFrame:
    """Adds `block`, 0 to blocks - 1: the distinct groups of a source in order, cut into contiguous blocks, and `training` (even blocks)."""
    groups = df.select(source, group).distinct()
    rank = F.row_number().over(W.partitionBy(source).orderBy(group)) - 1
    count = F.count("*").over(W.partitionBy(source))
    groups = groups.withColumn("block", F.least(F.lit(blocks - 1).cast("long"), F.floor(rank * blocks / count)))
    return df.join(groups, [source, group]).withColumn("training", F.col("block") % 2 == 0)


def ema(df: DataFrame, s: Series, value: Column, supported: Column, gain: float, decay: float, limit: float | None = None) -> DataFrame:
    """Adds `state`, folded in order: the first supported value starts it; then it moves by gain times the difference
    (at most limit either way, if given), or shrinks by decay where the value is not supported. Null before its start.

    Null values are not supported. A recurrence cannot be a plain window: the rows come sorted by source and time, and
    a task folds them as they pass, with one number of state; no source is held in memory.
    """
    rows = df.select(s.source, s.time, s.order, value.cast("double").alias("_v"), F.coalesce(supported, F.lit(False)).alias("_ok"))

    def fold(batches):
        source, last = None, None
        for batch in batches:
            states = []
            for key, v, ok in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if key != source:
                    source, last = key, None
                if ok and v is not None:
                    move = 0.0 if last is None else gain * (v - last)
                    if limit is not None:
                        move = max(-limit, min(limit, move))
                    last = v if last is None else last + move
                elif last is not None:
                    last *= decay
                states.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.float64())], names=[*batch.schema.names[:3], "state"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:3])
    return rows.repartition(s.source).sortWithinPartitions(s.source, s.time, s.order).mapInArrow(fold, f"{kinds}, state double")


def paced(df: DataFrame, s: Series, target: Column, step: float) -> DataFrame:
    """Adds `state`, which follows the target by at most `step` a row; starts at the first target."""
    return ema(df, s, target, F.lit(True), 1.0, 1.0, step)
