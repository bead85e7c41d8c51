"""Runs a streaming transformation over a finished table, once, and gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.scratch import scratch


def replay(table: DataFrame, folder: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """transform applied to the table's files as a stream (all that is there now, then stop), written with exactly-once Parquet output and read back."""
    spark, path = table.sparkSession, scratch(table.sparkSession)
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", name).parquet(folder)
    out = transform(stream)
    query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
