"""Ranking, greedy selection, sets, upserts and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in an order that ends with a unique key. [TOP-01, TOP-03]"""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_with_margin(df: DataFrame, keys: list[str], score: str, tie: str, least: float, margin: float) -> DataFrame:
    """The best row of a group, if its score reaches `least` and leads the next by `margin` (no next counts 0). [TOP-04]"""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    both = df.withColumn("__k", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead(score).over(w), F.lit(0)))
    return both.where((F.col("__k") == 1) & (F.col(score) >= least) & (F.col(score) - F.col("runner_up") >= margin)).drop("__k")


def suppressed(df: DataFrame, keys: list[str], time: str, score: str, tie: str, apart: int) -> DataFrame:
    """Greedy non-maximum suppression: best first, a row stays unless a kept one lies within `apart`. [TOP-05]

    The best row of a block of `apart` and of the blocks beside it stays for certain, and what is nearer to it goes. The
    others are cut where no two rows are within `apart` of each other, which no suppression crosses, and each cell is
    folded in order of score. So a dense stream is no single cell, unless its scores rise or fall all along. One exchange serves
    all windows. Rows without a time stay.
    """
    asked = df.columns
    rank = F.struct((-F.col(score)).alias("s"), F.col(time).alias("t"), F.col(tie).alias("i"))
    blocks = Window.partitionBy(*keys).orderBy("__block").rangeBetween(-1, 1)
    sure = df.withColumn("__block", F.floor(F.col(time) / max(apart, 1))).withColumn("__sure", F.when(rank == F.min(rank).over(blocks), F.col(time)))
    so_far = lambda *order: F.last("__sure", True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = (F.col(time) - F.col("__before") < apart) | (F.col("__after") - F.col(time) < apart)
    near = sure.withColumn("__before", so_far(time, tie)).withColumn("__after", so_far(F.desc(time), F.desc(tie))).withColumn("__near", F.coalesce(near, F.lit(False)))
    df = near.where(F.col("__sure").isNotNull() | ~F.col("__near")).select(*asked)
    w = Window.partitionBy(*keys).orderBy(time, tie)
    far = F.coalesce(F.col(time) - F.lag(time).over(w) >= apart, F.lit(True))
    cut = df.withColumn("__cell", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(time).alias("t"), F.col(tie).alias("i"))))
    kept = F.aggregate(
        rows, F.array().cast(f"array<struct<s:{dict(df.dtypes)[score]},t:{dict(df.dtypes)[time]},i:{dict(df.dtypes)[tie]}>>"),
        lambda a, x: F.when(F.exists(a, lambda y: F.abs(y["t"] - x["t"]) < apart), a).otherwise(F.concat(a, F.array(x))),
    )
    out = cut.groupBy(*keys, "__cell").agg(kept.alias("__all")).select(*keys, F.explode("__all").alias("__kept"))
    return out.select(*keys, F.col("__kept.t").alias(time), (-F.col("__kept.s")).alias(score), F.col("__kept.i").alias(tie))


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key: an upsert as a query. [SNK-04, JOI-15, STA-09]"""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version]))).where("__k = 1").drop("__k")


def overridden(base: DataFrame, manual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base rows with manual ones in their place; a manual null deletes. [SET-01, FLT-05]"""
    m = manual.select(*keys, F.col(value).alias("__m"), F.lit(True).alias("__by_hand"))
    both = base.join(m, keys, "full")
    out = both.withColumn(value, F.when(F.col("__by_hand"), F.col("__m")).otherwise(F.col(value))).withColumn("by_hand", F.coalesce("__by_hand", F.lit(False)))
    return out.where(F.col(value).isNotNull()).drop("__m", "__by_hand")


def histogram_2d(df: DataFrame, keys: list[str], x: Column, y: Column, weight: Column, width: int, height: int, nx: int, ny: int) -> DataFrame:
    """Weights in nx by ny equal cells over [0, width] x [0, height]; the upper edges belong to the last cells, outside is dropped. [AGG-04]

    Cells are found in whole numbers: x * nx div width.
    """
    inside = df.withColumn("__x", x).withColumn("__y", y).where("__x >= 0 and __y >= 0").where((F.col("__x") <= width) & (F.col("__y") <= height))
    cell = lambda c, n, size: F.least(F.floor(F.col(c) * n / size), F.lit(n - 1)).cast("int")
    return inside.groupBy(*keys, cell("__y", ny, height).alias("by"), cell("__x", nx, width).alias("bx")).agg(F.sum(weight).alias("weight"))


def votes(df: DataFrame, keys: list[str], choice: str, weight: str) -> DataFrame:
    """The choice with the largest summed weight of each group, its weight and the group's. [AGG-16]"""
    by = df.groupBy(*keys, choice).agg(F.sum(weight).alias("weight"))
    by = by.withColumn("total", F.sum("weight").over(Window.partitionBy(*keys)))
    return top_k(by, keys, [F.desc("weight"), choice], 1).drop("rank")


def stratified(df: DataFrame, label: str, order: list, caps: dict[str, int]) -> DataFrame:
    """The first rows of each class up to its cap, hard ones first by `order`; classes without a cap go. [TOP-10]

    A class at a time: its tasks send their first rows alone, so that a class is never sorted as a whole.
    """
    out = df.where(F.lit(False)).withColumn("rank", F.lit(0))
    for k, n in caps.items():
        first = df.where(F.col(label) == k).orderBy(*order).limit(n)
        out = out.unionByName(first.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order))))
    return out
