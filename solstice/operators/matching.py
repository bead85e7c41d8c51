"""Nearest neighbours, consensus and robust rotation fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .quantiles import exact_quantiles


def medoid(candidates: DataFrame, group: str, item: str, distance, within: float, minimum: int = 1) -> DataFrame:
    """Per group: the item of the least median distance to all (itself included), how many are within reach, and whether they are a strict majority.

    Ties go to the first item by id. distance: of columns a.* and b.* of the joined pair, but not of the item. Candidates that are alike in all columns but the item have the same distances:
    they are one with a weight, so pairs are those of different candidates, however many there are of each.
    """
    alike = [c for c in candidates.columns if c not in (group, item)]
    kinds = stored(candidates.groupBy(group, *alike).agg(F.min(item).alias(item), F.count("*").alias("_w")))
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}")).select(F.col(f"a.{group}").alias(group), F.col(f"a.{item}").alias(item), distance(F.col("a"), F.col("b")).alias("d"), F.col("b._w").alias("_w"))
    scores = pairs.groupBy(group, item).agg(F.percentile("d", F.lit(0.5), F.col("_w")).alias("median_distance"), F.coalesce(F.sum(F.when(F.col("d") <= within, F.col("_w"))), F.lit(0)).alias("consistent"), F.sum("_w").alias("n"))
    first = F.row_number().over(W.partitionBy(group).orderBy("median_distance", item))
    best = scores.withColumn("_k", first).where("_k = 1").drop("_k")
    required = F.greatest(F.lit(minimum).cast("long"), F.when(F.col("n") > 1, F.floor(F.col("n") / 2) + 1).otherwise(1))
    return best.withColumn("accepted", F.col("consistent") >= required)


def moments(pairs: DataFrame, source: tuple, target: tuple, *groups: str) -> DataFrame:
    """The nine sums of products that a rotation fit needs, as one aggregate."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}{j}") for i, a in enumerate(source) for j, b in enumerate(target)]
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), *sums)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_of_moments(m: pd.Series) -> pd.Series:
    """The rotation (row by row) that takes sources to targets best, from nine sums row by row."""
    x = np.stack([np.asarray(v, float).reshape(3, 3) for v in m]) if len(m) else np.zeros((0, 3, 3))
    u, _, vt = np.linalg.svd(x)
    turn = np.ones((len(x), 3))
    turn[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    fit = np.einsum("nji,nj,nkj->nik", vt, turn, u)
    return pd.Series(list(fit.reshape(-1, 9)))


def fit_rotations(pairs: DataFrame, source: tuple, target: tuple, group: str) -> DataFrame:
    """Per group: n and rotation array<double>(9), target = rotation * source in the least squares."""
    m = moments(pairs, source, target, group)
    return m.select(group, "n", rotation_of_moments(F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])).alias("rotation"))


def grid_shift(samples: DataFrame, source: str, index: str, value: str, shifts: range) -> DataFrame:
    """Per source: the shift of whole samples for which the series agrees best with its reference column, the first of equals.

    samples: index, value, reference. Each sample is joined with the references it can meet by
    an equi-join on the shifted index (explode of the fixed grid), and costs are partial sums.
    """
    moved = samples.select(source, F.explode(F.array(*[F.lit(k) for k in shifts])).alias("shift"), F.col(index), F.col(value)).withColumn("at", F.col(index) + F.col("shift"))
    other = samples.select(source, F.col(index).alias("at"), F.col("reference"))
    cost = moved.join(other, [source, "at"]).groupBy(source, "shift").agg(F.avg((F.col(value) - F.col("reference")) ** 2).alias("cost"), F.count("*").alias("n"))
    return cost.groupBy(source).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "shift")).alias("best"), F.max("n").alias("n")).select(source, F.col("best.shift").alias("shift"), F.col("best.cost").alias("cost"), "n")


def ranked(rows: DataFrame, group: str, lead: str, order: list[str], mean: int = 10_000) -> DataFrame:
    """rows with _rank (from 0 in its group by the order, which begins with the number `lead`) and _n, the group's rows.

    A group of any size is ranked in parallel: buckets of equal width over `lead`, `mean` rows each on average, are counted,
    running sums over the counts are the buckets' first ranks, and rows are numbered within their bucket.
    """
    # A table, so that Spark knows how few groups are: a plain join by group brings all rows of one to a task.
    ends = stored(rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(lead).cast("double").alias("_low"), F.max(lead).cast("double").alias("_high")))
    width = F.greatest((F.col("_high") - F.col("_low")) * mean / F.col("_n"), F.lit(1e-300))
    dealt = rows.join(ends, group).withColumn("_bucket", F.floor((F.col(lead).cast("double") - F.col("_low")) / width)).drop("_low", "_high")
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order))
    out = dealt.join(counts.select(group, "_bucket", before.alias("_first")), [group, "_bucket"])
    return out.withColumn("_rank", F.col("_first") + number - 1).drop("_bucket", "_first")


def sector_ratio(rows: DataFrame, group: str, order: list[str], first: str, second: str, sectors: int = 32, least: int = 16, bound: float = 0.6931471805599453) -> DataFrame:
    """Per group and sector (equal runs of the ordered rows): rows and the median of log(second / first), within the bounds; null where there are too few.

    The order begins with a number. The first sectors get the rows that don't divide evenly.
    """
    each, over = F.expr(f"_n div {sectors}"), F.col("_n") % sectors
    cut = F.when(F.col("_rank") < over * (each + 1), F.floor(F.col("_rank") / (each + 1))).otherwise(over + F.floor((F.col("_rank") - over * (each + 1)) / F.greatest(each, F.lit(1))))
    usable = ranked(rows, group, order[0], order).withColumn("sector", cut.cast("int")).where((F.col(first) > 0) & (F.col(second) > 0))
    ratios = stored(usable.select(group, "sector", F.ln(F.col(second) / F.col(first)).alias("_r")))  # read in passes
    out = exact_quantiles(ratios, [group, "sector"], F.col("_r"), [0.5])
    return out.select(group, "sector", "n", F.when(F.col("n") >= least, F.greatest(F.lit(-bound), F.least(F.lit(bound), F.get("q", F.lit(0))))).alias("log_ratio"))
