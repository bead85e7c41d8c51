"""Tables and folders in the place that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; on a local master a temporary one where the session names none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="solstice-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}"


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


def stored(df: DataFrame) -> DataFrame:
    """df, written there and read again: it is worked out once, and a lost executor loses nothing of it."""
    return stored_in_turn([df])


def stored_in_turn(parts: Iterable[DataFrame], path: str | None = None) -> DataFrame:
    """The rows of all parts, at least one and of one schema, as stored() has them: written one part after the other, so that the shuffle files of one are there at a time.

    path: of scratch(), for what is to be deleted before the results are read.
    """
    for df in parts:
        path = path or scratch(df.sparkSession)
        with shuffles_deleted(df.sparkSession):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(path: str) -> None:
    """Deletes a table of scratch() that nothing reads any more."""
    files, place = fs.FileSystem.from_uri(path)
    files.delete_dir(place)
