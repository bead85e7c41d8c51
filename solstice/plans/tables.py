"""The driver's tables, as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import Series

SERIES = Series("user_id", "us", "event_id")
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: user_id is the source, us the clock in microseconds (whatever the session's time zone)."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", us.alias("us"), "value", "event_type", "props")


#: The same in SQL.
EVENTS = "ev as (select event_id, user_id, epoch_us(ts) as us, value, event_type, props from events)"
