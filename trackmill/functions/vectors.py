"""Vectors in array columns: similarity, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector has length one. [SFN-16]"""
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def weighted_mean(df: DataFrame, keys: list[str], vector: str, weight: Column, least: int = 1) -> DataFrame:
    """Per group the weighted mean of a vector column, element by element; groups of fewer than `least` rows go. [AGG-25, AGG-26]"""
    e = df.select(*keys, weight.alias("__w"), F.posexplode(vector).alias("pos", "x"))
    m = e.groupBy(*keys, "pos").agg((F.sum(F.col("x") * F.col("__w")) / F.sum("__w")).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"), F.first("n").alias("n"))


def weighted_centroid(df: DataFrame, keys: list[str], points: list[str], variance: Column) -> DataFrame:
    """Inverse-variance weighted centroid and its precision 1 / sqrt(sum of weights). [AGG-24]"""
    w = 1 / variance
    return df.groupBy(*keys).agg(*[(F.sum(F.col(p) * w) / F.sum(w)).alias(p) for p in points], (1 / F.sqrt(F.sum(w))).alias("precision"))
