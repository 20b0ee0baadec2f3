"""Quality by an interpolated modified Kneser-Ney model of byte n-grams.

The model is a set of tables in Spark, a pair for each order: the n-grams seen, with their interpolated
probability, and the contexts seen, with the weight they leave to the shorter context. Counts of trusted
text are summed per task and then by n-gram; lower orders count in how many kinds of longer n-grams an
n-gram ends; probabilities come from joins of the counts with their contexts and with the next lower
order. An n-gram is a number of 9 bits a byte (0 stands for the border of a text).

A document is kept if its perplexity a byte is at most its language's limit: a quantile of trusted
documents' perplexities, times a margin. Trusted text is that of all documents labelled 1: the model's counts
come from all of it, and quantiles (to a ten-thousandth of the ranks) from all their perplexities. Scores are over all
documents and whole texts. Workers hold the commonest n-grams, at most `most_held`, so that no task of a join meets
them; a text's other n-grams, once each with their number, are joined with the model's tables. (A model
of no more rows than that is held as a whole.) Log probabilities are whole numbers of 2^-24, so sums don't depend on their order.

Defined results: null and empty texts have no perplexity and are not kept; a language without
trusted documents (null too) takes the limit of all of them; without any trusted document all
texts are kept; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import join_hot, store

ORDER, BITS = 5, 9
KINDS = 257  # bytes and the end of a text
PORTION = 2_000_000
#: Log probabilities are added up as whole numbers of this size.
UNIT = 2.0**-24
#: Rows of the model that workers hold at most.
HELD = 1 << 18


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte and at the text's end."""
    c = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64) + 1
    c = np.concatenate([np.zeros(order - 1, np.int64), c, [0]])
    n = len(c) - order + 1
    key = c[:n].copy()
    for i in range(1, order):
        key <<= BITS
        key |= c[i : i + n]
    return key


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): the n-grams of a one-column frame of texts; tasks send theirs added up, up to 4 million kinds at once."""

    def rows(batches):
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for x in batch.column(0):
                if found := x.as_py():
                    held.append(np.unique(grams(found, order), return_counts=True))
                    size += len(held[-1][0])
                if size > PORTION:
                    held = [merged()]
                    size = len(held[0][0]) // 2
                    if len(held[0][0]) > 2 * PORTION:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["g", "c"])
                        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["g", "c"])

    return texts.mapInArrow(rows, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more, from the numbers of n-grams with counts of one to four."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1))


def tables(highest: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """From counts of the highest order: per order, lowest first, (g, p, c) of the n-grams seen and (context, free) of the contexts seen.

    p is interpolated over all orders; an n-gram that isn't seen has `free` of its context times the probability of the n-gram without its
    first byte, and without a context seen that probability itself.
    """
    by_order = [store(highest, "counts")]
    for k in range(order - 1, 0, -1):
        by_order.append(store(by_order[-1].groupBy(F.col("g").bitwiseAND((1 << BITS * k) - 1).alias("g")).agg(F.count("*").alias("c")), "counts"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, seen in enumerate(reversed(by_order), 1):
        n = seen.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d = discounts(*n)
        off: Column = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = seen.withColumn("context", F.shiftright("g", BITS))
        contexts = seen.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("free"))
        own = seen.join(contexts, "context").select("g", ((F.col("c") - off) / F.col("total")).alias("own"), "free", "c")
        if k == 1:
            p = own.select("g", (F.col("own") + F.col("free") / KINDS).alias("p"), "c")
        else:
            shorter = out[-1][0].select(F.col("g").alias("short"), F.col("p").alias("q"))
            p = own.withColumn("short", F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(shorter, "short").select("g", (F.col("own") + F.col("free") * F.col("q")).alias("p"), "c")
        out.append((store(p, "grams"), store(contexts.select("context", "free"), "contexts")))
    return out


@dataclass
class Model:
    """Tables as sorted arrays of keys with log values: those of all orders, lowest first, or common n-grams of the highest order alone."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram of the highest order; NaN for those that a model in part lacks."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        if not self.contexts:
            found, value = lookup(self.grams[0], keys)
            return np.where(found, value, np.nan)
        for k in range(len(self.grams), 0, -1):
            part = keys[left] & ((1 << BITS * k) - 1)
            found, value = lookup(self.grams[k - 1], part)
            out[left] += np.where(found, value, 0.0)
            left, part = left[~found], part[~found]
            known, value = lookup(self.contexts[k - 1], part >> BITS)
            out[left] += np.where(known, value, 0.0)
        out[left] -= np.log(KINDS)
        return out


def lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the keys are in a sorted table, and their values."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def commonest(grams: DataFrame, most: int) -> DataFrame:
    """The n-grams of the highest counts, at most `most`, none of them if as many share the highest; counts within a sixteenth are kept or left together."""
    size = F.floor(F.log2("c") * 16)
    least, n = None, 0
    for r in grams.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        n += r["n"]
        if n > most:
            break
        least = r["size"]
    return grams.where(size >= least) if least is not None else grams.limit(0)


def held(found: list[tuple[DataFrame, DataFrame]], most: int = HELD) -> Model:
    """The part of a model that the workers hold: its tables, if they have at most `most` rows together, or else its commonest n-grams."""

    def arrays(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(F.col(key).alias("k"), F.log(value).cast("float").alias("v")).toArrow()
        keys, values = got["k"].to_numpy(), got["v"].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    if sum(x.count() for pair in found for x in pair) > most:
        return Model([arrays(commonest(found[-1][0], most), "g", "p")], [])
    return Model([arrays(g, "g", "p") for g, _ in found], [arrays(c, "context", "free") for _, c in found])


def looked_up(kinds: DataFrame, found: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, p): the probabilities of distinct n-grams, seen or not. Order by order, each n-gram is joined with its own row, its context's, and
    what its end has got; of each of these at most 257 n-grams are one."""
    needed = [kinds.select("g")]
    for k in range(len(found) - 1, 0, -1):
        needed.append(needed[-1].select(F.col("g").bitwiseAND((1 << BITS * k) - 1).alias("g")).distinct())
    out: DataFrame | None = None
    for k, (grams, contexts) in enumerate(found, 1):
        q = needed[-k].withColumn("context", F.shiftright("g", BITS)).join(grams.select("g", "p"), "g", "left").join(contexts.select("context", "free"), "context", "left")
        if out is None:
            shorter: Column = F.lit(1 / KINDS)
        else:
            q, shorter = q.withColumn("short", F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(out.toDF("short", "q"), "short"), F.col("q")
        out = store(q.select("g", F.coalesce("p", F.coalesce("free", F.lit(1.0)) * shorter).alias("p")), "looked_up")
    return out


def perplexities(docs: DataFrame, found: list[tuple[DataFrame, DataFrame]], key: str, text: str, carry: list[str], most_held: int = HELD) -> DataFrame:
    """Per document: key, carried columns, n_grams, perplexity a byte (null without text)."""
    shared = docs.sparkSession.sparkContext.broadcast(held(found, most_held))

    def scores(texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each text's sum over the n-grams held, and all others as (text, n-gram, number); a portion's distinct n-grams are looked up once each."""
        kinds, at = np.unique(np.concatenate([*texts, np.zeros(0, np.int64)]), return_inverse=True)
        log, ends = shared.value.log_p(kinds), np.cumsum([0, *map(len, texts)])
        other = np.isnan(log)
        total = np.append(0, np.cumsum(np.where(other, 0, np.rint(log / UNIT)).astype(np.int64)[at]))[ends]
        rest = np.flatnonzero(other[at])
        pairs, n = np.unique((np.searchsorted(ends, rest, side="right") - 1) * len(kinds) + at[rest], return_counts=True)
        return np.diff(total), [pairs // max(len(kinds), 1), kinds[pairs % max(len(kinds), 1)], n]

    def rows(batches):
        for batch in batches:
            n, parts, waiting, size, first = [], [], [], 0, 0

            def scored():
                total, (at, *rest) = scores(waiting)
                parts.append([total, at + first, *rest])

            for x in batch.column(batch.num_columns - 1):
                of = x.as_py()
                k = grams(of) if of else np.zeros(0, np.int64)
                n.append(len(k))
                waiting.append(k)
                size += len(k)
                if size > PORTION:
                    scored()
                    waiting, size, first = [], 0, len(n)
            scored()
            total, at, g, times = (np.concatenate(x) for x in zip(*parts))
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(n) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(g), pa.array(times)], ["g", "times"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(total), rest], [*batch.schema.names[:-1], "n_grams", "__log", "__rest"])

    picked = docs.select(F.monotonically_increasing_id().alias("__row"), key, *carry, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop(text).schema)
    scored = store(picked.mapInArrow(rows, f"{fields}, n_grams bigint, __log bigint, __rest array<struct<g: bigint, times: bigint>>"), "scores")
    rest = scored.select("__row", F.inline("__rest"))
    kinds = store(rest.groupBy("g").agg(F.count("*").alias("n")), "kinds")
    total = kinds.agg(F.sum("n")).first()[0]
    log: Column = F.col("__log")
    if total:
        p = looked_up(kinds, found).select("g", F.rint(F.log("p") / UNIT).cast("long").alias("log")).join(kinds, "g")
        sums = join_hot(rest, p, ["g"], "n", total).groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("__more"))
        scored, log = scored.join(sums, "__row", "left"), log + F.coalesce("__more", F.lit(0))
    return scored.select(key, *carry, "n_grams", F.when(F.col("n_grams") > 0, F.exp(-log * UNIT / F.col("n_grams"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", label: str = "quality", quantile: float = 0.995, margin: float = 1.1, most_held: int = HELD) -> DataFrame:
    """Per document: key, language, n_grams, perplexity, limit, kept.

    Two passes over the texts (trusted ones, scores) and a join of scores, without texts, with the labels. A language with a
    thousandth of the documents or more, at most a thousand of them, gets its limit by broadcast.
    """
    trusted = labels.groupBy(key).agg(F.min(label).alias("__y")).where((F.col("__y") >= 1) & F.col(key).isNotNull()).select(key)
    # the keys grow with the corpus: a plan that broadcast them would not hold
    model = tables(counts(docs.select(key, text).join(trusted.hint("shuffle_hash"), key).select(text)))
    scored = store(perplexities(docs, model, key, text, [language], most_held), "perplexity").withColumn("__lang", F.coalesce(F.concat(F.lit("="), F.col(language)), F.lit("")))
    known = scored.join(trusted, key).where("perplexity is not null")
    q = lambda: F.percentile_approx("perplexity", quantile, 10_000) * margin
    per = known.where(F.col(language).isNotNull()).groupBy("__lang").agg(q().alias("__limit"))
    overall = known.agg(q().alias("q")).first()["q"]
    languages = scored.groupBy("__lang").agg(F.count("*").alias("__n")).join(per, "__lang", "left")
    out = join_hot(scored, languages, ["__lang"], "__n", scored.count())
    limit = F.coalesce(F.col("__limit"), F.lit(overall), F.lit(float("inf")))
    return out.select(key, language, "n_grams", "perplexity", limit.alias("limit"), (F.col("perplexity").isNotNull() & (F.col("perplexity") <= limit)).alias("kept"))
