"""Exact quantiles of groups of any size by refined histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of an ordered 64-bit key that a pass finds: a histogram has 2**BITS cells at most for each rank that is looked for.
BITS = 16


@F.arrow_udf(T.LongType())
def ordered_key(values: pa.Array) -> pa.Array:
    """A whole number for each double, in the same order; equal numbers have one key, -0.0 that of 0.0."""
    bits = (np.asarray(values.to_numpy(zero_copy_only=False), np.float64) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)), mask=np.asarray(values.is_null()))


@F.arrow_udf(T.DoubleType())
def key_value(keys: pa.Array) -> pa.Array:
    """The double of an ordered key."""
    bits = keys.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def exact_quantiles(df: DataFrame, group: list[str], value: Column, probabilities: list[float]) -> DataFrame:
    """(group, n, q array<double>): each group's quantiles of the value, interpolated linearly between neighbouring ranks; n values that are neither null nor NaN.

    No group is sorted or gathered. Values are ordered 64-bit keys; each of four passes counts, for every rank that is looked for, the next 16 bits of the keys that
    agree with what is known of it, so a pass shuffles counts, 2**16 for a rank at most. df is read five times: give it a table or something cheap. Groups of nulls are groups; a group without values
    has no row.
    """
    named = [f"_g{k}" for k in range(len(group))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(group, named, strict=True)], value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.select(*named, ordered_key("_v").alias("_key"))
    sizes = rows.groupBy(*named).agg(F.count("*").alias("n"))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities])))
    sought = sizes.select(*named, "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(64 - BITS, -1, -BITS):
        digit = F.shiftright("_key", shift) if shift == 64 - BITS else F.shiftright("_key", shift).bitwiseAND((1 << BITS) - 1)
        if shift == 64 - BITS:
            cells = rows.withColumn("prefix", F.lit(0).cast("long"))
        else:
            known = sought.select(*named, "prefix").distinct().withColumnsRenamed({n: f"{n}_" for n in named} | {"prefix": "prefix_"})
            of = rows.withColumn("prefix", F.shiftright("_key", shift + BITS))
            cells = of.join(known, [F.col("prefix") == F.col("prefix_"), *[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in named]], "left_semi")
        cells = cells.groupBy(*named, "prefix", digit.alias("digit")).agg(F.count("*").alias("c"))
        before = W.partitionBy(*named, "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("less", F.coalesce(F.sum("c").over(before), F.lit(0)))
        cells = cells.withColumnsRenamed({n: f"{n}_" for n in named} | {"prefix": "prefix_"})
        inside = (F.col("rank") - F.col("below") >= F.col("less")) & (F.col("rank") - F.col("below") < F.col("less") + F.col("c"))
        met = sought.join(cells, [F.col("prefix") == F.col("prefix_"), *[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in named], inside])
        sought = met.select(*named, "n", "rank", (F.col("prefix") * (1 << BITS) + F.col("digit")).alias("prefix"), (F.col("below") + F.col("less")).alias("below"))
    found = sought.select(*named, "n", "rank", key_value("prefix").alias("v"))
    at = found.groupBy(*named, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a probability

    def of(p: float) -> Column:
        low, high = F.col("at")[F.floor(place(p))], F.col("at")[F.ceil(place(p))]
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return at.select(*[F.col(n).alias(g) for g, n in zip(group, named, strict=True)], "n", F.array(*[of(p) for p in probabilities]).alias("q"))
