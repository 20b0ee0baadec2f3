"""What is known of a track, as a state of bounded size that merges: parts of a track can come in any order, cut anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["clip_id", "track_id"]
#: Rows at either end whose heights count, colours kept, tallest boxes kept (fixed values).
ENDS, COLOURS, TALLEST = 5, 160, 6


def _least(lists: Column, n: int) -> Column:
    """The n smallest of lists of structs together."""
    return F.slice(F.sort_array(F.flatten(lists)), 1, n)


def part_states(rows: DataFrame, frames: int = 1000) -> DataFrame:
    """States of parts of tracks, `frames` frames at most each. Rows: clip_id, track_id, idx, t, x1, y1, x2, y2, x, y (place or null), lab (shirt colour or null).

    Lists in a state are ordered and cut: the first and last rows, the tallest boxes, and the colours whose
    numbers are smallest, a number being a hash of the frame, so that any way of cutting a track keeps the same ones. [AGG-31]
    """
    h = F.col("y2") - F.col("y1")
    foot = [((F.col("x1") + F.col("x2")) / 2).alias("fx"), F.col("y2").alias("fy"), h.alias("h")]
    # Ends of a track: time and frame first, negated for the last ones.
    up, down = F.struct("t", "idx", *foot), F.struct((-F.col("t")).alias("t"), (-F.col("idx")).alias("idx"), *foot)
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    p0, p1 = F.struct("t", "idx", "x", "y"), F.struct((-F.col("t")).alias("t"), (-F.col("idx")).alias("idx"), "x", "y")
    tall = F.struct((-h).alias("h"), "idx", *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    shade = F.when(F.col("lab").isNotNull(), F.struct(F.xxhash64("clip_id", "track_id", "idx").alias("rank"), "idx", "lab"))
    r = rows.withColumn("__part", F.floor(F.col("idx") / frames))
    each = r.groupBy(*KEYS, "__part").agg(
        F.count("*").alias("n"), *[F.array_agg(c).alias(n) for c, n in ((up, "first"), (down, "last"), (tall, "tallest"), (shade, "colours"))],
        F.min(F.when(placed, p0)).alias("p0"), F.min(F.when(placed, p1)).alias("p1"),
    )
    cut = lambda c, n: _least(F.array(F.col(c)), n).alias(c)
    return each.select(*KEYS, "n", cut("first", ENDS), cut("last", ENDS), cut("tallest", TALLEST), cut("colours", COLOURS), "p0", "p1")


def merged(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One state of several of the same keys; merging in any order and grouping gives the same. New keys, such as a chain's root, merge whole tracks."""
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[_least(F.collect_list(c), n).alias(c) for c, n in (("first", ENDS), ("last", ENDS), ("tallest", TALLEST), ("colours", COLOURS))],
        F.min("p0").alias("p0"), F.min("p1").alias("p1"),
    )


def median(values: Column) -> Column:
    """The median of an array; null if empty."""
    s = F.sort_array(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def finished(states: DataFrame) -> DataFrame:
    """The summary of a state: rows, first and last (t, idx, foot), first and last place, median heights at both ends, median colour, tallest boxes. [AGG-12, AGG-15, WIN-18]"""
    end = lambda c, s: F.struct((s * F.get(c, F.lit(0))["t"]).alias("t"), (s * F.get(c, F.lit(0))["idx"]).alias("idx"), F.get(c, F.lit(0))["fx"].alias("fx"), F.get(c, F.lit(0))["fy"].alias("fy"))
    heights = lambda c: median(F.transform(c, lambda r: r["h"]))
    shade = lambda i: median(F.transform("colours", lambda c: c["lab"][i]))
    lab = F.array(*[shade(i) for i in range(3)])
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")))
    boxes = F.transform("tallest", lambda b: F.struct(b["idx"].alias("idx"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2")))
    keys = [c for c in states.columns if c not in ("n", "first", "last", "tallest", "colours", "p0", "p1")]
    return states.select(
        *keys, "n", end("first", F.lit(1)).alias("first"), end("last", F.lit(-1)).alias("last"), place("p0").alias("p0"), place("p1").alias("p1"),
        heights("first").alias("h0"), heights("last").alias("h1"), F.when(F.size("colours") > 0, lab).alias("lab"), boxes.alias("tallest"),
    )
