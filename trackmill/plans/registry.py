"""A register that keeps each query next to its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: events in whole units: microseconds since the epoch, hundredths of the value, team by parity.
EVENTS_SQL = """WITH b AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS us,
  CAST(round(value * 100) AS BIGINT) AS v, user_id % 2 AS team, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events)"""


def query(sql: str | None = None, events: bool = True):
    """Register a query under its function's name; sql gets the events prelude unless events is false."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (EVENTS_SQL + sql) if events else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("kind"), us.alias("us"), F.round(F.col("value") * 100).cast("long").alias("v"),
        (F.col("user_id") % 2).alias("team"), F.floor(us / 86_400_000_000).alias("day"),
    )
