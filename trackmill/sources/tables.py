"""Reading and writing of tables: scans, overwrites, upserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackmill.operators.choose import latest
from trackmill.sources.schemas import TABLES


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema; filters on clip_id prune partitions. [SRC-01, SRC-04]"""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none. [SRC-03]"""
    return df.where(F.col(key) == value).limit(1)


def frame_rate(frames: DataFrame) -> DataFrame:
    """(clip_id, fps): frames less one over the time between the first and last, 10 where that says nothing. [SRC-02]"""
    a = frames.groupBy("clip_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    return a.select("clip_id", F.coalesce(F.when(F.col("n") > 1, F.try_divide(F.col("n") - 1, F.when(F.col("span") > 0, F.col("span")))), F.lit(10.0)).alias("fps"))


def with_motion(frames: DataFrame, motion: DataFrame) -> DataFrame:
    """Frames with their motion matrix, the identity where there is none. [SRC-05]"""
    one = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    return frames.join(motion, ["clip_id", "idx"], "left").withColumn("h", F.coalesce("h", one))


def overwrite(df: DataFrame, root: str, name: str, by: str = "clip_id", analysed: list | None = None) -> None:
    """Replace the partitions that df touches and no others: results of a clip are rewritten whole. [SNK-01, SNK-02, SNK-11, SNK-12]

    analysed: the clips whose results df holds; the old rows of one without any result go too, after the others are written. df is evaluated once.
    Readers may see some clips' new rows before others'; sources.published makes several tables visible at once.
    """
    if not analysed:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")
        return
    spark, seen = df.sparkSession, Observation()
    watched = df.observe(seen, F.collect_set(F.when(F.col(by).isin(analysed), F.col(by))).alias("found"))  # at most as many as analysed
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")
    for key in set(analysed) - set(seen.get["found"]):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{by}={key}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows replaced or joined by changed ones of the same key. [SNK-03, SNK-04, STR-10]"""
    both = base.withColumn("__v", F.lit(0)).unionByName(changes.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__v"]).drop("__v")


def without_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent exists: a cascade as a query."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def export_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header and a byte order mark on the first name. [SNK-05]"""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def label_lines(df: DataFrame, cls: str, box: list[str], width: str, height: str) -> DataFrame:
    """Training label lines: class, centre and size as shares of the image. [SNK-08]"""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    share = lambda v, of: F.format_number(v / F.col(of), 6)
    return df.select("*", F.concat_ws(" ", F.col(cls).cast("string"), share((x1 + x2) / 2, width), share((y1 + y2) / 2, height), share(x2 - x1, width), share(y2 - y1, height)).alias("line"))
