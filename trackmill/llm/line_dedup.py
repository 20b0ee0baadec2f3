"""Deleting later copies of repeated line runs by a suffix array over line ids, in DataFrame functions only.

A run of neighbouring non-blank lines counts as a passage from `min_words` words on. Every line
inside a passage that occurs elsewhere earlier (in the order of key, then row, then line) is
deleted; the first copy stays. Runs end at document borders; blank lines are no part of runs.

How: lines become ids (the rank of a 128-bit hash), and prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: the pairs (rank of the first half, rank of the second) that occur at least
twice are sorted by range partitioning and numbered in order. Suffixes alone in their interval drop out, so levels
shrink, and doubling ends once the ranks reach the longest run that still has to be told apart.
Suffixes that share their first n lines form a longest-common-prefix interval; it is identified by
the ranks of its first and last 2**k lines, 2**k <= n < 2**(k + 1). Lines, pairs and intervals with a thousandth of the rows
or more, at most a thousand of them, meet their ranks and first copies by broadcast, all others in shuffles.

A maximal repeated run of enough words is the union of the shortest passages inside it that start
or end at one of its lines. So only these, at most two a line and of at most `min_words` lines, are
looked up; their intervals' first members are the first copies.

Defined results: null text stays null, empty text empty; a text that loses its last non-blank line
becomes empty; a repeated row is a later copy of the row before it; null keys come first; an empty
table gives an empty result; extra columns are carried through (one named like the result is replaced), what is added lives in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackmill.llm.common import drop_stored, join_hot, store


def lines_of(text: Column) -> Column:
    """The non-blank lines: raw index, two 64-bit hashes, number of words."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(
            i.alias("raw"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("line"), x).alias("g"),
            F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("w"),
        ),
    )
    return F.filter(lines, lambda x: x["w"] > 0)


def ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs that occur at least twice, with a `rank` in their order and how often, `count`.

    Stored, as the bounds of range partitioning are sampled: numbered twice, pairs may get other ranks.
    """
    often = pairs.groupBy(a, b).count().where("count > 1")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(often.repartitionByRange(n, a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def passages(ranks: DataFrame, min_words: int) -> DataFrame:
    """The shortest passages from and up to each line within stretches of repeated lines: (uid, start, n).

    With c the words up to and including a line, a passage from `a` ends at the first line whose c
    reaches that of the line before `a` plus min_words: one ordered pass over targets and lines.
    """
    by_doc = Window.partitionBy("uid").orderBy("ln")
    at = ranks.withColumn("island", F.col("ln") - F.row_number().over(by_doc))
    at = at.withColumn("c", F.sum("w").over(Window.partitionBy("uid", "island").orderBy("ln"))).withColumn("b", F.col("c") - F.col("w"))
    rows = F.array(
        F.struct(F.col("c").alias("v"), F.lit(1).alias("kind"), F.col("ln").alias("ln")),  # a line ends
        F.struct((F.col("b") + min_words).alias("v"), F.lit(0).alias("kind"), F.col("ln").alias("ln")),  # wanted: first end at v or later
        F.struct(F.col("b").alias("v"), F.lit(2).alias("kind"), F.col("ln").alias("ln")),  # a line begins
        F.struct((F.col("c") - min_words).alias("v"), F.lit(3).alias("kind"), F.col("ln").alias("ln")),  # wanted: last begin at v or earlier
    )
    e = at.select("uid", "island", F.explode(rows).alias("e")).select("uid", "island", "e.*")
    order = Window.partitionBy("uid", "island").orderBy("v", "kind")
    e = e.withColumn("end", F.first(F.when(F.col("kind") == 1, F.col("ln")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    e = e.withColumn("begin", F.last(F.when(F.col("kind") == 2, F.col("ln")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = e.where("kind = 0 and end is not null").select("uid", F.col("ln").alias("start"), (F.col("end") - F.col("ln") + 1).alias("n"))
    back = e.where("kind = 3 and begin is not null").select("uid", F.col("begin").alias("start"), (F.col("ln") - F.col("begin") + 1).alias("n"))
    return ahead.union(back).distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, result: str = "dedup") -> DataFrame:
    """All rows and columns of docs, the text without deleted lines, with a struct `result`: n_lines, n_deleted, deleted (line indices from 0)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != result])
    marked = store(docs.withColumn("__uid", F.monotonically_increasing_id()), "stamped")
    lines = marked.select(F.col("__uid").alias("uid"), F.col(f"`{key}`").alias("key"), F.posexplode(lines_of(F.col(f"`{text}`"))).alias("ln", "x"))
    lines = store(lines.select("uid", "key", "ln", "x.*"), "lines")
    level = store(join_hot(lines, ranked(lines, "h", "g"), ["h", "g"], "count", lines.count()).select("uid", "key", "ln", "raw", "w", F.col("rank").alias("r")), "rank")
    drop_stored(docs.sparkSession, lines)
    wanted = store(passages(level, min_words).withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")), "passages")
    found = None
    k = 0
    top = wanted.agg(F.max("k")).first()[0]
    here = level.select("uid", "ln", "r")
    while top is not None and k <= top:
        ends = wanted.where(F.col("k") == k).withColumn("last", F.col("start") + F.col("n") - 2**k)
        named = ends.join(here.select("uid", F.col("ln").alias("start"), F.col("r").alias("ra")), ["uid", "start"])
        named = named.join(here.select("uid", F.col("ln").alias("last"), F.col("r").alias("rb")), ["uid", "last"]).select("uid", "start", "n", "k", "ra", "rb")
        found = named if found is None else found.union(named)
        if k < top:
            both = here.join(here.select("uid", (F.col("ln") - 2**k).alias("ln"), F.col("r").alias("s")), ["uid", "ln"])
            both = store(both, "pairs")
            here = store(join_hot(both, ranked(both, "r", "s"), ["r", "s"], "count", both.count()).select("uid", "ln", F.col("rank").alias("r")), "rank")
        k += 1
    if found is None:
        deleted = level.select("uid", F.col("raw").alias("raw")).limit(0)
    else:
        place = F.struct("key", "uid", "start")
        found = store(found.join(level.select("uid", F.col("ln").alias("start"), "key"), ["uid", "start"]), "intervals")
        first = found.groupBy("n", "k", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        later = join_hot(found, first, ["n", "k", "ra", "rb"], "copies", found.count()).where(~place.eqNullSafe(F.col("first")))
        gone = later.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("ln")).distinct()
        deleted = gone.join(level, ["uid", "ln"]).select("uid", "raw")
    deleted = deleted.groupBy(F.col("uid").alias("__uid")).agg(F.sort_array(F.collect_list("raw")).alias("__gone"))
    gone = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    raw = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("__gone"))
    rest = F.array_join(F.element_at(F.transform(F.array(raw), lambda ls: F.transform(kept, lambda i: F.get(ls, i))), 1), "\n")
    cleaned = F.when(F.col("__gone").isNull() | F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).when(rest.rlike(r"[^\x20\x09-\x0D]"), rest).otherwise("")
    return marked.join(deleted, "__uid", "left").select(
        *[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.coalesce(F.size(raw), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"), gone.alias("deleted")).alias(result),
    )
