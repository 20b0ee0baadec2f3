"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in a seeded random order, are cut into blocks. With integer shares a_s of the
sources and the period D = sum of a_s, block j (from 0) of source s is released at floor(j*D/a_s) and due
at ceil((j+1)*D/a_s); earliest-deadline-first fills one slot after the other with a released block. Such
a schedule exists, repeats after D slots and keeps each source's blocks less than one from its
fluid share at all times. So one period is scheduled, by a fold over its D slots, and every block
finds its slot by arithmetic: no global sort, no pass over the blocks in sequence.

A source with a share of 0 comes after all others have run out, with a share of 1. A source that runs out ends a phase; the others go on with their shares alone, so every document
is placed. In the last period of a phase, which the source that runs out can't fill, its empty slots are skipped.

Defined results: null sources are one source of their own; null ids and repeated rows are placed
like others (equal rows take neighbouring places in either order); an empty table gives an empty
result; extra columns are carried through (one named like the result is replaced), what is added lives in one struct. Every source
is a stream with its own share at any count: beyond `most_streams` sources the driver schedules each phase with a
heap, at most one slot a block and share, and blocks meet their slots in a join by source and number.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackmill.llm.common import store


def shares_of(sizes: dict[str, int], power: float = 0.7, parts: int = 400) -> dict[str, int]:
    """Integer target shares that flatten the sources' sizes: proportional to size ** power, one at least."""
    total = sum(n**power for n in sizes.values()) or 1
    return {s: max(1, round(parts * n**power / total)) for s, n in sizes.items()}


def period(shares: Column) -> Column:
    """The streams served in the slots of one period, as an array of indices into `shares`.

    Among the streams with a released block the one whose block is due first is served; ties go
    to the smaller share, then to the smaller index.
    """
    total = F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x)

    def fold(d: Column) -> Column:
        def pick(done: Column, t: Column) -> Column:
            due = F.transform(
                shares,
                lambda a, i: F.when(
                    (a > 0) & (F.get(done, i) < a) & (F.floor(F.get(done, i) * d / a) <= t),
                    F.struct(F.ceil((F.get(done, i) + 1) * d / a).alias("due"), a.alias("a"), i.alias("i")),
                ),
            )
            return F.array_min(due)["i"]

        def serve(acc: Column, t: Column) -> Column:
            def served(i: Column) -> Column:
                return F.struct(
                    F.transform(acc["done"], lambda n, k: n + F.when(k == i, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("done"),
                    F.concat(acc["order"], F.array(i)).alias("order"),
                )

            return F.element_at(F.transform(F.array(pick(acc["done"], t)), served), 1)

        start = F.struct(F.transform(shares, lambda a: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), d - 1), start, serve, lambda acc: acc["order"])

    return F.element_at(F.transform(F.array(total), fold), 1)


def phases(blocks: list[int], shares: list[int]) -> list[tuple[list[int], list[int], list[int], int]]:
    """Per phase: the shares of its streams (0: run out), the first block of each, the blocks it places, its first slot.

    Each phase ends with at least one stream run out, so there are at most as many as streams.
    """
    done, slot, out = [0] * len(blocks), 0, []
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        live = [a if d < b else 0 for a, d, b in zip(shares, done, blocks, strict=True)]
        if not any(live):
            live = [int(d < b) for d, b in zip(done, blocks, strict=True)]
        by = gcd(*[a for a in live if a])
        live = [a // by for a in live]
        rounds = min(-(-(b - d) // a) for a, d, b in zip(live, done, blocks, strict=True) if a)
        placed = [min(b - d, a * rounds) for a, d, b in zip(live, done, blocks, strict=True)]
        out.append((live, list(done), placed, slot))
        done = [d + p for d, p in zip(done, placed, strict=True)]
        slot += rounds * sum(live)  # empty slots of the last round are skipped: slots order, they needn't be dense
    return out


def one_period(shares: list[int]) -> list[int]:
    """What `period` gives, for many streams: a heap of the released blocks by due slot."""
    d, order = sum(shares), []
    released = [(-(-d // a), a, i) for i, a in enumerate(shares)]
    released.sort()
    done, later = [0] * len(shares), {}
    for t in range(d):
        for x in later.pop(t, ()):
            heappush(released, x)
        _, a, i = heappop(released)
        order.append(i)
        done[i] += 1
        if done[i] < a:
            later.setdefault(max(t + 1, done[i] * d // a), []).append((-(-(done[i] + 1) * d // a), a, i))
    return order


def many_slots(names: list[str], blocks: list[int], shares: list[int]) -> list[tuple]:
    """(source, phase, base, d, at, q, a, first, placed): the slots of all phases that `phases` and `period` give; only streams that go on cost anything in a phase."""
    out: list[tuple] = []
    live, done, slot, p = [i for i, b in enumerate(blocks) if b], [0] * len(blocks), 0, 0
    waiting = [i for i in live if not shares[i]]
    live = [i for i in live if shares[i]]
    while live or waiting:
        if not live:
            live, waiting = waiting, []
        by = gcd(*[shares[i] or 1 for i in live])
        own = [(shares[i] or 1) // by for i in live]
        rounds = min(-(-(blocks[i] - done[i]) // a) for i, a in zip(live, own, strict=True))
        placed = [min(blocks[i] - done[i], a * rounds) for i, a in zip(live, own, strict=True)]
        d, q = sum(own), [0] * len(live)
        for at, k in enumerate(one_period(own)):
            if q[k] < placed[k]:
                out.append((names[live[k]], p, slot, d, at, q[k], own[k], done[live[k]], placed[k]))
            q[k] += 1
        for k, i in enumerate(live):
            done[i] += placed[k]
        slot, p = slot + rounds * d, p + 1
        live = [i for i in live if done[i] < blocks[i]]
    return out


def numbered(rows: DataFrame, n_buckets: int, key: str) -> DataFrame:
    """rows (with a source __s and a hash __o) with `__n`, their numbers from 0 within the source, in order of the hash.

    No source is gathered: a row's number is its bucket's offset plus its place within the bucket, and offsets are summed
    up in two levels, so that no task counts more than a source's n_buckets / 1000 groups or a group's 1000 buckets.
    """
    rows = rows.withColumn("__b", F.floor((F.shiftrightunsigned("__o", 1) / F.lit(float(2**63))) * n_buckets).cast("long"))
    before = lambda *by, order: F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = store(rows.groupBy("__s", "__b").count().withColumn("__g", F.floor(F.col("__b") / 1000)), "buckets")
    groups = counts.groupBy("__s", "__g").agg(F.sum("count").alias("count")).withColumn("__ahead", before("__s", order="__g")).drop("count")
    offsets = counts.join(groups, ["__s", "__g"]).withColumn("__before", F.col("__ahead") + before("__s", "__g", order="__b")).select("__s", "__b", "__before")
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__o", F.col(f"`{key}`"))))
    return placed.join(offsets, ["__s", "__b"]).withColumn("__n", F.col("__before") + F.col("__r") - 1)


def interleave(docs: DataFrame, key: str = "doc_id", source: str = "source", shares: dict[str, int] | None = None, block: int = 16, seed: int = 1, most_streams: int = 32, result: str = "mix") -> DataFrame:
    """All rows and columns of docs with a struct `result`: stream, block, slot, release, deadline, place, phase.

    Ordering by (slot, place) gives the mixed corpus. Buckets for the numbering hold about `per_bucket` rows.
    """
    per_bucket = 500
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != result])
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))  # no source: the empty name
    counted = {r["s"]: r["n"] for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).collect()}
    if not counted:
        empty = "struct<stream:string,block:bigint,phase:int,slot:bigint,release:bigint,deadline:bigint,place:int>"
        return docs.withColumn(result, F.lit(None).cast(empty))
    names = sorted(counted)
    target = shares_of(counted) if shares is None else {s: shares.get(s[1:] if s else None, 1) for s in names}
    if any(a < 0 for a in target.values()):
        raise ValueError("a share is 0 at least")
    n_buckets = max(1, sum(counted.values()) // per_bucket)
    # the whole row is hashed, so that rows without a key, or of one key, are spread; equal rows stay together
    order = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), *[F.col(f"`{c}`") for c, t in docs.dtypes if c != key and not t.startswith("map")])
    rows = numbered(docs.select("*", name.alias("__s"), order.alias("__o")), n_buckets, key).withColumn("__k", F.floor(F.col("__n") / block))

    spark = docs.sparkSession
    blocks, own = [-(-counted[s] // block) for s in names], [target[s] for s in names]
    if len(names) > most_streams:
        kinds = "__s string, p int, base bigint, d bigint, at int, q int, a bigint, first bigint, placed bigint"
        slots = store(spark.createDataFrame(many_slots(names, blocks, own), kinds), "slots")
        each = slots.withColumn("__k", F.explode(F.expr("sequence(first + q, first + placed - 1, a)")))
        at = each.select(
            "__s", "__k", F.struct("first", "a").alias("__span"), F.col("p").alias("__p"), F.expr("(__k - first) div a").alias("__round"),
            F.col("base").alias("__base"), F.col("d").alias("__d"), F.col("at").alias("__at"),
        )
        held = rows.join(at, ["__s", "__k"])
    else:
        plan = phases(blocks, own)
        # one row a phase, from literals: at most as many phases as streams, at most most_streams streams
        tables = spark.range(1).select(
            F.explode(
                F.array(*[
                    F.struct(F.lit(p).alias("p"), F.lit(slot).cast("long").alias("base"), *[F.array(*[F.lit(x).cast("long") for x in xs]).alias(c) for c, xs in (("shares", live), ("first", first), ("placed", placed))])
                    for p, (live, first, placed, slot) in enumerate(plan)
                ])
            ).alias("x")
        ).select("x.*")
        tables = tables.withColumn("order", period(F.col("shares"))).withColumn("d", F.size("order").cast("long"))
        slots = tables.select("*", F.posexplode("order").alias("at", "i"))
        slots = slots.withColumn("q", F.row_number().over(Window.partitionBy("p", "i").orderBy("at")) - 1).select(
            F.element_at(F.array(*[F.lit(s) for s in names]), F.col("i") + 1).alias("__s"), "p", "base", "d", "at", "q",
            F.get("shares", F.col("i")).alias("a"), F.get("first", F.col("i")).alias("first"), F.get("placed", F.col("i")).alias("placed"),
        )
        slots = store(slots, "slots")
        # a block's phase first (streams x phases rows), then its slot within the period
        spans = slots.where("q = 0").select("__s", "p", "first", "placed", "a").withColumnRenamed("p", "__p")
        spans = spans.groupBy("__s").agg(F.sort_array(F.collect_list(F.struct("first", "placed", "a", F.col("__p").alias("p")))).alias("__spans"))
        held = rows.join(F.broadcast(spans), "__s").withColumn("__span", F.element_at(F.filter("__spans", lambda x: x["first"] <= F.col("__k")), -1)).drop("__spans")
        held = held.withColumn("__q", F.pmod(F.col("__k") - F.col("__span.first"), F.col("__span.a"))).withColumn("__round", F.floor((F.col("__k") - F.col("__span.first")) / F.col("__span.a")))
        at = slots.select(F.col("__s"), F.col("p").alias("__p"), F.col("q").cast("long").alias("__q"), F.col("base").alias("__base"), F.col("d").alias("__d"), F.col("at").alias("__at"))
        held = held.withColumn("__p", F.col("__span.p")).join(F.broadcast(at), ["__s", "__p", "__q"])
    j, a, d = F.col("__k") - F.col("__span.first"), F.col("__span.a"), F.col("__d")
    return held.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            F.when(F.col("__s") != "", F.substring("__s", 2, 1 << 30)).alias("stream"), F.col("__k").alias("block"), F.col("__p").alias("phase"),
            (F.col("__base") + F.col("__round") * d + F.col("__at")).alias("slot"),
            (F.col("__base") + F.floor(j * d / a)).alias("release"), (F.col("__base") + F.ceil((j + 1) * d / a)).alias("deadline"),
            F.pmod(F.col("__n"), F.lit(block)).cast("int").alias("place"),
        ).alias(result),
    )
