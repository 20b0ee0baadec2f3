"""Several tables rewritten together: new files first, then one small manifest that makes them all visible at once.

A root holds `data`, where files are only ever added, and `manifests`, a table with a row for each table and key value: the folder of its rows. Readers take the
greatest version. A manifest is one file that Spark's committer moves into place, so a job that fails before leaves the old state, files and all.
Two writers of one version: the second one's folder exists, and it fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, name string, value string, path string"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows (version, name, value, path) of a version, the last one by default; empty where nothing was published."""
    try:
        all_ = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifests")
    except AnalysisException as e:  # no folder yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    last = all_.agg(F.max("version")).first()[0] if version is None else version
    return all_.where(F.col("version") == F.lit(last).cast("long"))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], by: str = "clip_id", replaced: list | None = None) -> int:
    """Replace the rows of the key values in each table, or of `replaced` if it is given, by those of `tables`; the new version. [SNK-02, SNK-11, SNK-12]

    Each table is evaluated once. Values in `replaced` without new rows end up without any. Other tables, and other values, keep their files. A null value is a value too.
    """
    old = manifest(spark, root)
    rows = []
    for name, df in tables.items():
        path = f"{root}/data/{name}/{uuid.uuid4().hex}"
        value = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))
        df.withColumn("__at", F.sha2(value, 256)).write.partitionBy("__at").parquet(path)
        if df.sparkSession.read.schema("__at string").parquet(path).isEmpty():
            continue
        found = spark.read.schema(StructType([f for f in df.schema if f.name == by]).add("__at", "string")).parquet(path).select(value.alias("value"), "__at").distinct()
        rows.append(found.select(F.lit(name).alias("name"), "value", F.concat(F.lit(f"{path}/__at="), "__at").alias("path")))
    new = spark.createDataFrame([], "name string, value string, path string")
    for r in rows:
        new = new.union(r)
    gone = new.select("name", "value")
    if replaced is not None:
        listed = [(n, "null" if v is None else f"={v}") for n in tables for v in replaced]
        gone = gone.union(spark.createDataFrame(listed, "name string, value string"))
    kept = old.select("name", "value", "path").join(gone.distinct(), ["name", "value"], "left_anti")
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    out = kept.union(new).select(F.lit(version).cast("long").alias("version"), "name", "value", "path")
    mark = spark.createDataFrame([(version, None, None, None)], MANIFEST)  # a version without rows is one too
    out.union(mark).coalesce(1).write.mode("error").parquet(f"{root}/manifests/{version:012d}")
    return version


def read(spark: SparkSession, root: str, name: str, schema: StructType | str, only: list | None = None, version: int | None = None) -> DataFrame:
    """A published table, or the rows of some key values alone, whose folders are then the only ones that are opened. [SRC-01]"""
    m = manifest(spark, root, version).where(F.col("name") == name)
    if only is not None:
        m = m.where(F.col("value").isin([("null" if v is None else f"={v}") for v in only]))
    paths = [r["path"] for r in m.select("path").collect()]  # folders, as any scan lists them
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
