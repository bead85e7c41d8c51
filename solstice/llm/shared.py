"""Shared storage, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes 0x20 and 0x09 to 0x0D, as SQL and regular expressions write them.
WHITE = " \t\n\x0b\x0c\r"
#: Python gets batches of about so many bytes.
BATCH_BYTES = 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Where that is unset on a local master
    (one machine), a temporary folder is made once per session; on any other it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="solstice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The scope that owns what is written now: one for each thread and call, so two queries at once never own each other's files.
_owner: contextvars.ContextVar[Storage | None] = contextvars.ContextVar("owner", default=None)


class Storage:
    """Owns the folders and tables that operators write within its `with` block.

    Results that are not read yet read these folders, so nothing is deleted by itself: release()
    deletes once results are stored elsewhere. A block inside another hands what it has not released to that one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Storage:
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)
        if (outer := _owner.get()) is not None:
            outer.paths += self.paths

    def release(self, but: int = 0) -> None:
        """Deletes what was written so far within the block, but for the last few folders."""
        cut = len(self.paths) - but
        gone, self.paths = self.paths[:cut], self.paths[cut:]
        for path in gone:
            files, place = fs.FileSystem.from_uri(path)
            if files.get_file_info(place).type == fs.FileType.Directory:
                files.delete_dir(place)
            name = place.rsplit("/", 1)[-1].rsplit("-", 1)[0]
            if name.startswith("line_run_"):  # a table of the catalogue
                self.spark.sql(f"drop table if exists `{name}`")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (owner := _owner.get()) is not None:
        owner.paths.append(path)
    return path


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    narrow: rows are few and short for the session's shuffle partitions (a pair of ids for
    some of the documents), so a sixteenth of the tasks writes them, in as many files.
    """
    path = new_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """Within it, a write's shuffle files are deleted when it is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes that Python gets in a batch in this session, for jobs that run later: rows may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(spark.conf.get(name).removesuffix("b"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, jobs that run at once hand Python at most so many rows and about BATCH_BYTES a batch: for rows that are large or that a batch gathers."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], str(min(rows, int(before[0])) if int(before[0]) > 0 else rows))
    size = int(before[1].removesuffix("b"))
    spark.conf.set(names[1], str(min(size, BATCH_BYTES) if size > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def ascii_lower(text):
    """Lower-cases A-Z only. Pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every id that an edge names, the smallest id reachable.

    edges: columns src and dst. Large-star and small-star steps (Kiveris et al.,
    "Connected Components in MapReduce and Beyond", 2014): each round replaces
    the edges by edges to smaller neighbours, never more than before, until they
    form stars around the component minima. Each round is two aggregations and
    two joins on partitioned edges; nothing is collected but a count and a
    checksum. Self loops and repeated edges are ignored; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = materialize(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges", narrow=True,
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        # an edge to the own minimum is kept by its larger end
        down = least.where("m < u").select("u", F.col("m").alias("v"))
        large = materialize(large.unionByName(down).distinct(), "large", narrow=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", narrow=True)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # The edges are now stars: every non-minimum points at its component's minimum.
    return now.select(u.alias("id"), v.alias("component")).unionByName(
        now.select(v.alias("id"), v.alias("component")).distinct()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
