"""Iteration with tables: paths of least cost and fix points, each round joining only what the last one changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.sources.stored import stored


def shortest_paths(edges: DataFrame, seeds: DataFrame, keys: list[str], reach: float | None = None) -> DataFrame:
    """Paths of least cost from any seed to every node that can be reached: (keys, node, cost, path from the seed on). [STA-16]

    edges: keys, src, dst, cost (not negative); seeds: keys, node, cost (what it costs to begin there). Graphs of all keys are walked at once. Equal
    costs: fewer nodes, then the smaller path. reach: paths over this cost are left out. Null nodes and costs lead nowhere.

    Each round joins the nodes that got cheaper with their edges, and keeps the cheapest offer for each node before it meets what is known; both
    tables are written. Rounds are as many as the longest cheapest path has edges.
    """
    names = [*keys, "node"]
    label = F.struct("cost", F.size("path").alias("n"), "path")
    begin = seeds.where("node is not null and cost is not null").select(*names, F.col("cost").cast("double").alias("cost")).withColumn("path", F.array("node"))
    edges = edges.where("src is not null and dst is not null and cost >= 0").select(*keys, F.col("src").alias("node"), F.col("dst").alias("to"), F.col("cost").cast("double").alias("more"))

    def cheapest(df: DataFrame) -> DataFrame:
        if reach is not None:
            df = df.where(F.col("cost") <= reach)
        return df.groupBy(*names).agg(F.min(label).alias("best")).select(*names, "best.cost", "best.path")

    known = frontier = stored(cheapest(begin), "paths")
    while not frontier.isEmpty():
        offers = frontier.join(edges, names).select(*keys, F.col("to").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", F.array("to")).alias("path"))
        old = known.select(*names, label.alias("old"))
        frontier = stored(cheapest(offers).join(old, names, "left").where(F.col("old").isNull() | (label < F.col("old"))).drop("old"), "frontier")
        known = stored(known.join(frontier.select(*names), names, "left_anti").unionByName(frontier), "paths")
    return known


def fix_point(first: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """first, and all that step(what the last round added, all so far) adds, until a round adds nothing. [CAL-06]

    A row whose keys are known is not added. Null keys count as equal. Every round's rows are written; all so far is the union of those files.
    """
    found = added = stored(first, "round")
    while not added.isEmpty():
        new = step(added, found).select(*first.columns)
        old = found.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        added = stored(new.join(old, same, "left_anti"), "round")
        found = found.unionByName(added)
    return found
