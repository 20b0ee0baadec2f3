"""What the text operators share: table reading, shared storage, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
_own_dir: list[str] = []
_stored: ContextVar = ContextVar("stored")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves a local session; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="trackmill-"))
    return f"file://{_own_dir[0]}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors and start from a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored_so_far().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_so_far() -> list[str]:
    """Folders of the tables that store() wrote in this thread, oldest first."""
    if (found := _stored.get(None)) is None:
        _stored.set(found := [])
    return found


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that store() returned, once nothing reads them any more."""
    delete(spark, [df.stored_at])


def release(spark: SparkSession, paths: list[str], still_read: DataFrame) -> None:
    """Delete stored tables, but none if `still_read` reads from one of them."""
    names = [p.rsplit("/", 1)[1] for p in paths]
    if not any(n in f for f in still_read.inputFiles() for n in names):
        delete(spark, paths)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key and its number of left rows, or more, in `weight`.

    Keys with a `most`-th of `total` (the rows of left, or more) each are at most `most`: they are broadcast, so no task gets a hot
    key's rows. All others, each with less than a `most`-th of the rows, are shuffled. left is read twice. A null key has no partner.
    """
    hot = right.where(F.col(weight) * most >= total).drop(weight)
    cold = right.where(F.col(weight) * most < total).drop(weight)
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how), allowMissingColumns=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row: lambda variables are not inlined into nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_bucket(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
