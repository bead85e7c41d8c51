"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WHITE, ascii_lower, materialize, new_path, shuffles_deleted


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hash_lines(lines: Column, min_chars: int) -> Column:
    """array<struct<h1,h2>>: a 128-bit hash for each line whose key is long enough, else null."""

    def one(line):
        key = line_key(line)
        return F.when(
            (F.octet_length(line) >= min_chars) & (F.char_length(key) >= min_chars),
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")),
        )

    return F.transform(lines, one)


def split_lines(text: Column) -> Column:
    """A null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled sorted runs of line hashes, as bucketed and sorted tables.

    A run has one row per key: (h1, h2, n), n being the number of documents that
    had the line. All runs are bucketed by h1 into as many buckets and sorted
    within them, so the anti-joins of new batches and compactions read them
    without a shuffle. Every `fanout` runs of a level are compacted into one run
    of the next, so a key is rewritten a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.ledger: list[DataFrame] = []

    def _store(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        # Dealt out by bucket first: one file for each, not one for each task and bucket.
        writer = df.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
        with shuffles_deleted(self.spark):
            writer.option("path", new_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes a batch (h1, h2, n, doc_id: the largest with the line); returns its keys that no run has yet."""
        keys = self._store(keys)
        fresh = keys
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        fresh = self._store(fresh.select("h1", "h2", "doc_id"))
        self.ledger.append(fresh)
        self.levels[0].append(keys.select("h1", "h2", "n"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._store(merged))
            level += 1
        return fresh

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def common(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the lines in at least min_docs documents; keeper is the document of the first batch that had it."""
        counts = self._merge(self.runs()).where(F.col("n") >= min_docs).select("h1", "h2")
        first = self.ledger[0]
        for more in self.ledger[1:]:
            first = first.unionByName(more)
        return counts.join(first.withColumnRenamed("doc_id", "keeper"), ["h1", "h2"])


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of docs: its id, the columns in keep, lines array<string> (all), dropped array<boolean> (per line), kept string.

    Lines whose key (see line_key) has min_chars code points and occurs in
    min_docs documents lose all their occurrences, except those in the document
    of the largest id that has it. Documents come in batches from the largest ids to the
    smallest, so the batch in which a key is fresh names its keeper. Ids may be of any kind that has an order.

    Null and empty texts have one empty line, which stays. A null id counts as
    one document, below all others. Repeated rows of an id are one document for
    counting; each row is returned. No rows give no rows. Other columns of docs
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    keep = keep or []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)), reverse=True)
    else:  # a thousand ids, by hash, say about where to cut
        some = sorted(r.doc_id for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(1000).collect())
        cuts = sorted({some[k * len(some) // batches] for k in range(1, batches)} if some else (), reverse=True)
    batch = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") >= cut, k).otherwise(batch)
    hashed = docs.select("doc_id", batch.alias("batch"), F.explode(F.array_distinct(hash_lines(split_lines(F.col("text")), min_chars))).alias("h"))
    hashed = hashed.where("h is not null").select("doc_id", "batch", "h.h1", "h.h2")
    staged = new_path(spark, "line-hashes")
    hashed.write.partitionBy("batch").parquet(staged)
    schema = hashed.select("doc_id", "h1", "h2", "batch").schema
    runs = LineRuns(spark, fanout)
    for k in range(len(cuts) + 1):
        part = spark.read.schema(schema).parquet(staged).where(F.col("batch") == k)
        one = F.struct(F.col("doc_id").isNull(), "doc_id")  # counts a null id as well
        runs.add(part.groupBy("h1", "h2").agg(F.count_distinct(one).alias("n"), F.max("doc_id").alias("doc_id")))
    # A table of its own, so that the join below can split a line that very many documents have.
    common = materialize(runs.common(min_docs), "common-lines")
    seen = spark.read.schema(schema).parquet(staged).select("doc_id", "h1", "h2").distinct()
    drops = (
        seen.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id"))
        .agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))
    )
    lines = split_lines(F.col("text"))
    joined = docs.join(drops, docs.doc_id.eqNullSafe(drops.drop_id), "left").withColumn("lines", lines)
    flags = F.when(F.col("drop").isNull(), F.transform("lines", lambda _: F.lit(False))).otherwise(
        F.transform(hash_lines(F.col("lines"), min_chars), lambda h: h.isNotNull() & F.coalesce(F.array_contains(F.col("drop"), h), F.lit(False)))
    )
    joined = joined.select("doc_id", *keep, "text", "lines", flags.alias("dropped"))
    kept = F.when(~F.exists("dropped", lambda x: x), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter("lines", lambda _, i: ~F.get("dropped", i)), "\n")
    )
    return joined.select("doc_id", *keep, "lines", "dropped", kept.alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("dropped", lambda x: x)).cast("long").alias("n_dropped"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
    from documents
), keyed as (
    select doc_id, i, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from lines
), common as (
    select k, max(doc_id) as keeper from keyed where length(k) >= 40
    group by k having count(distinct doc_id) >= 5
), flagged as (
    select doc_id, i, line, (keeper is not null and keeper <> doc_id) as dropped
    from keyed left join common using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from flagged group by doc_id
"""
