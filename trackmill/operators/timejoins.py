"""Joins in time: as-of, nearest with tolerance, interval semi and anti joins, nearest per group.

As-of joins merge both sides into one ordered pass per key (a shuffle and a sort, no pairs);
interval joins carry an equality on key and time bucket, so no plan holds a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, direction: str = "backward", tolerance: int | None = None, name: str = "found") -> DataFrame:
    """Each left row with the (time, value) of the last right row at or before it, the first at or after, or the nearer (the earlier of two as near). [JOI-08, JOI-09, JOI-10, JOI-26]

    Of right rows at one time the largest value counts.
    """
    kept = right.groupBy(*keys, time).agg(F.max(value).alias("__v"))
    l = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(f"struct<t:bigint,v:{dict(kept.dtypes)['__v']}>"))
    r = kept.select(*keys, time, F.lit(0).alias("__side"), F.struct(F.col(time).alias("t"), F.col("__v").alias("v")).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = F.last("__r", True).over(Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__r", True).over(Window.partitionBy(*keys).orderBy(time, F.desc("__side")).rowsBetween(0, Window.unboundedFollowing))
    if direction == "backward":
        found = back
    elif direction == "forward":
        found = ahead
    else:
        found = F.when(ahead.isNull() | (F.col(time) - back["t"] <= ahead["t"] - F.col(time)), back).otherwise(ahead)
    out = both.withColumn(name, found).where("__side = 1").drop("__side", "__r")
    if tolerance is not None:
        out = out.withColumn(name, F.when(F.abs(F.col(f"{name}.t") - F.col(time)) <= tolerance, F.col(name)))
    return out


def later_sample(df: DataFrame, keys: list[str], time: str, tie: str, value: str, ahead: int, or_last: bool = False, within: int | None = None) -> DataFrame:
    """Self as-of: the first sample at least `ahead` later in the same series, else the last one if asked. [JOI-06, JOI-07]"""
    w = Window.partitionBy(*keys).orderBy(time)
    pick = F.first(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(w.rangeBetween(ahead, Window.unboundedFollowing))
    if or_last:
        last = F.last(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(0, Window.unboundedFollowing))
        pick = F.coalesce(pick, F.when(last["t"] > F.col(time), last))
    out = df.withColumn("later", pick)
    return out if within is None else out.withColumn("later", F.when(F.col("later.t") - F.col(time) <= within, F.col("later")))


def bucketed(df: DataFrame, start: Column, end: Column, size: int, name: str = "__bucket") -> DataFrame:
    """A row for each time bucket that [start, end] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def interval_semi(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_time: str, anti: bool = False) -> DataFrame:
    """Left rows for which a right row of the same key lies in their closed span, or none does. [JOI-11, JOI-12]

    A null key finds nothing, so anti keeps it. By counts: right rows up to the span's end less those before its start, from one ordered pass a key; no pairs.
    """
    a, b = left_span
    marked = left.withColumn("__id", F.struct(*left.columns)).withColumn("__a", a).withColumn("__b", b)
    probes = marked.select(*keys, "__id", F.explode(F.array(F.struct(F.col("__a").alias("t"), F.lit(0).alias("o")), F.struct(F.col("__b").alias("t"), F.lit(2).alias("o")))).alias("p"))
    points = right.select(*keys, F.lit(None).cast(dict(marked.dtypes)["__id"]).alias("__id"), F.struct(F.col(right_time).alias("t"), F.lit(1).alias("o")).alias("p"))
    w = Window.partitionBy(*keys).orderBy("p.t", "p.o").rowsBetween(Window.unboundedPreceding, 0)
    seen = probes.unionByName(points).withColumn("__n", F.sum((F.col("p.o") == 1).cast("long")).over(w)).where("__id is not null")
    hit = seen.groupBy(*keys, "__id").agg((F.max("__n") - F.min("__n")).alias("__hits"))
    out = marked.join(hit, [*keys, "__id"], "left").where((F.coalesce("__hits", F.lit(0)) == 0) if anti else (F.col("__hits") > 0))
    return out.drop("__id", "__a", "__b", "__hits")


def overlap_anti(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, more_than: int, bucket: int) -> DataFrame:
    """Left intervals that overlap no right interval of the same key by more than `more_than`. [JOI-13]"""
    l = bucketed(left.withColumn("__id", F.struct(*left.columns)), F.col(start), F.col(end), bucket)
    r = bucketed(right.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e")), F.col("__s"), F.col("__e"), bucket)
    hit = l.join(r, [*keys, "__bucket"]).where(F.least(F.col(end), F.col("__e")) - F.greatest(F.col(start), F.col("__s")) > more_than).select("__id").distinct()
    return left.withColumn("__id", F.struct(*left.columns)).join(hit, "__id", "left_anti").drop("__id")


def last_overlapping(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[Column, Column], start: str, end: str, pick: str, bucket: int) -> DataFrame:
    """Each left row with `pick` of the right interval that overlaps its span and ends last; of equal ends the smallest pick. [JOI-14]"""
    a, b = span
    marked = left.withColumn("__id", F.struct(*left.columns)).withColumn("__a", a).withColumn("__b", b)
    l = bucketed(marked, F.col("__a"), F.col("__b"), bucket)
    r = bucketed(right.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(pick).alias("__p")), F.col("__s"), F.col("__e"), bucket)
    hits = l.join(r, [*keys, "__bucket"]).where((F.col("__s") <= F.col("__b")) & (F.col("__e") >= F.col("__a")))
    best = hits.groupBy("__id").agg(F.max(F.struct("__e", (-F.col("__p")).alias("p"))).alias("m"))
    return marked.join(best, "__id", "left").withColumn("last_" + pick, -F.col("m.p")).drop("__id", "__a", "__b", "m")


def nearest(df: DataFrame, other: DataFrame, keys: list[str], distance: Column, pick: str, radius: float | None = None) -> DataFrame:
    """Per key the `pick` of the other side at the smallest distance, ties to the smallest pick; optionally within a radius. [JOI-05, JOI-17]"""
    pairs = df.join(other, keys).withColumn("distance", distance)
    if radius is not None:
        pairs = pairs.where(F.col("distance") <= radius)
    return pairs.groupBy(*[c for c in df.columns]).agg(F.min(F.struct("distance", pick)).alias("__m")).select(*df.columns, F.col(f"__m.{pick}").alias(pick), F.col("__m.distance").alias("distance"))
