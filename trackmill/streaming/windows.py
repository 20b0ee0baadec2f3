"""Event-time forms: windows and sessions with watermarks, and appending sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding event-time windows; events later than the watermark are dropped. [STR-08]"""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key: the streaming form of islands in time. [STR-08, WIN-10]"""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Micro-batches appended to a table exactly once; restarts go on from the checkpoint. [SNK-01, STR-01, STR-07]"""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
