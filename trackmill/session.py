"""A session with what the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "trackmill", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow; keyword arguments override (dots as underscores twice)."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return SparkSession.builder.appName(app).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
