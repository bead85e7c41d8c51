"""Publishing results: content-addressed receipts and tables that are never overwritten."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(recipe: dict) -> str:
    """SHA-256 of a recipe as canonical JSON: keys sorted, no white space; NaN is refused."""
    return hashlib.sha256(json.dumps(recipe, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def strict_json(text: str, limit: int = 16 << 20) -> dict:
    """JSON of bounded size, without NaN and Infinity."""
    if len(text.encode()) > limit:
        raise ValueError("document too large")

    def refuse(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_constant=refuse)


def publish(df: DataFrame, path: str, recipe: dict) -> DataFrame:
    """Writes df as Parquet where nothing is yet, then its receipt; returns the receipt row (recipe_sha256, rows, content_hash).

    The receipt comes last: a folder without one is not a result. content_hash does not depend on the order of rows.
    """
    df.write.mode("errorifexists").parquet(f"{path}/data")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    receipt = receipt_of(stored).withColumn("recipe_sha256", F.lit(fingerprint(recipe)))
    receipt.coalesce(1).write.mode("errorifexists").json(f"{path}/receipt")
    return df.sparkSession.read.schema(receipt.schema).json(f"{path}/receipt")


def receipt_of(df: DataFrame) -> DataFrame:
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("content_hash"))


def verify(spark, path: str) -> bool:
    """Whether a published table is what its receipt says."""
    receipt = spark.read.json(f"{path}/receipt").first()
    now = receipt_of(spark.read.parquet(f"{path}/data")).first()
    return (now["rows"], now["content_hash"]) == (receipt["rows"], str(receipt["content_hash"]))


@contextlib.contextmanager
def locked(path: str):
    """Holds a lock file on the driver's storage: made only if it isn't there, and removed only if it is still the same file."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    mine = os.fstat(handle)
    try:
        yield
    finally:
        os.close(handle)
        with contextlib.suppress(FileNotFoundError):
            now = os.stat(path)
            if (now.st_dev, now.st_ino) == (mine.st_dev, mine.st_ino):
                os.unlink(path)
