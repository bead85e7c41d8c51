"""Contracts: rules over tables that return violations as rows, and the set operations around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input breaks its contract."""


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that does not hold on a row; a null result does not hold.

    One pass over the rows: the failed rules are an array that is exploded.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return df.select(F.col(key), F.explode(failed).alias("rule"))


def require(found: DataFrame, what: str) -> None:
    """Raises with the first violations, if there are any. An action: it runs before the job whose input it guards."""
    first = found.take(5)
    if first:
        raise ContractError(f"{what}: " + "; ".join(", ".join(map(str, x)) for x in first))


def single_valued(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """Per group: rows, and for each column whether all rows have one value (nulls not counted)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"single_{c}") for c in columns])


def lookup(df: DataFrame, names: DataFrame, key: str, name_key: str, name: str, default: str = "unknown") -> DataFrame:
    """df with the dimension's name, or the default where it has none."""
    found = names.select(F.col(name_key).alias("_k"), F.col(name).alias("_n"))
    return df.join(found, df[key] == found._k, "left").withColumn(name, F.coalesce("_n", F.lit(default))).drop("_k", "_n")


def resolve_mode(first: Column, second: Column) -> Column:
    """Of two optional declarations by name: unknown if either is; conflicting if they differ; unspecified without any."""
    names = F.array_distinct(F.array_compact(F.array(first, second)))
    return (
        F.when(F.array_contains(names, "unknown"), "unknown")
        .when(F.size(names) > 1, "conflicting")
        .otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("unspecified")))
    )


def done(jobs: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """The jobs of which a receipt says that they have run."""
    return jobs.join(receipts.select(key).distinct(), key, "left_semi")


def pending(jobs: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    return jobs.join(receipts.select(key).distinct(), key, "left_anti")


def collisions(outputs: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """(path, reason): outputs that are inputs as well, and outputs that several jobs write."""
    clash = outputs.select(path).intersect(inputs.select(path)).withColumn("reason", F.lit("is an input"))
    twice = outputs.groupBy(path).count().where("count > 1").select(path, F.lit("written twice").alias("reason"))
    return clash.unionByName(twice)


def edge_hash(content: Column, edge: int = 1 << 20) -> Column:
    """SHA-256 of the first and the last `edge` characters or bytes together; they overlap in short content."""
    tail = F.substring(content, F.greatest(F.length(content) - edge + 1, F.lit(1)), F.lit(edge))
    return F.sha2(F.concat(F.substring(content, F.lit(1), F.lit(edge)).cast("binary"), tail.cast("binary")), 256)


def audio_window(first: Column, count: Column, fps_num: Column, fps_den: Column, rate: Column, origin_num: Column, origin_den: Column) -> tuple[Column, Column]:
    """First sample and the one behind the last, of frames [first, first + count): (origin + frame / fps) * rate, each rounded to even by itself.

    Exact: whole decimals only, nothing passes through a double.
    """
    from ..functions.numeric import round_half_even_ratio

    def sample(frame):
        d = lambda x: x.cast("decimal(12,0)")
        over = d(fps_num) * d(origin_den)
        top = (d(origin_num) * d(fps_num) + d(frame) * d(fps_den) * d(origin_den)).cast("decimal(30,0)") * rate.cast("decimal(7,0)")
        return round_half_even_ratio(top.cast("decimal(38,0)"), over.cast("decimal(38,0)")).cast("long")

    return sample(first), sample(first + count)
