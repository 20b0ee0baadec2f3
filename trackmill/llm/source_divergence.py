"""How far the sources of a language differ in their words: exact divergences of pairs of sources, and each source's own terms.

Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A language keeps
the V terms that at least `least_docs` of its documents hold. A group (lang, source) with N kept
occurrences gives a term with c of them p = 1 + floor(10^9 (c + 1) / (N + V)); the language as a whole
gives it q likewise. A group a diverges from p to q by f(p, q) = floor((p - q)^2 / q).

How: identical texts of a language are collapsed to one, with the number of copies in each source, and each
text is tokenised once; its terms count as often as it has copies. What is left is one row for each
(lang, source, term) that occurs. The sum of f over all kept terms needs only these: terms that
neither source has all give the same f, terms that one source has depend on the count there alone (so
a histogram of counts, not the terms, meets the other sources), and terms that both have are joined by term:

    sum f = V f(p0, q0) + sum over a's terms of [f(p, q0) - f(p0, q0)] + sum over b's terms of [f(p0, q) - f(p0, q0)]
          + sum over common terms of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

with p0, q0 what a count of 0 gives. All arithmetic is in integers and decimals.

Scale: texts are shuffled once, copies combined before that. Occurrences are combined in the tasks that
tokenise. Keys (lang, term) have a row for each source at most. Groups with a thousandth of the kept rows or more meet their totals by broadcast,
at most a thousand of them. The result has a row for each ordered pair of sources, as asked.

Defined results: null text, lang and source count as empty, together with those that are empty;
a group without terms takes part (c = 0 everywhere); V = 0 gives value 0 to all pairs; a language with one source has no pairs; repeated rows count
each; ties are ranked by the item's UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackmill.llm.common import drop_stored, join_hot, store

#: UTF-8 bytes of terms as they are, A-Z lower-cased, ASCII characters that are no letters blank.
SPLIT_AND_LOWER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (ord(chr(c).lower()) if c < 128 else c for c in range(256)))


def whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def quotient(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, a not negative, b positive; null where b is 0."""
    return F.call_function("div", whole(a), F.when(b > 0, whole(b)))


def share(count: Column, total: Column, terms: Column) -> Column:
    """A term's smoothed share in units of 10^-9, 1 at least; null if nothing is kept."""
    return F.lit(1).cast("long") + quotient(whole(F.lit(1_000_000_000)) * (whole(count) + 1), total + terms)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square of two shares fits into a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def collapsed(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each text of a language, with its number of copies in each source: (lang, text, copies array<(source, n)>)."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    read = read.withColumn("h", F.unhex(F.sha2("text", 256)))
    copies = read.groupBy("lang", "h", "source").agg(F.count("*").alias("n"))
    copies = copies.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return read.groupBy("lang", "h").agg(F.first("text").alias("text")).join(copies.hint("shuffle_merge"), ["lang", "h"]).select("lang", "text", "copies")


def occurrences(texts: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(lang, source, term, c, docs): how often a source's documents hold a term, and how many do; term is null in a row that names the group.

    A worker adds up what it has read and hands it on when it holds `most_held` terms, and at the end. The result is partitioned by (lang, term), for
    all that follows: a key gets a row for each source and hand-over at most.
    """

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, docs, held = defaultdict(Counter), defaultdict(Counter), 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                terms, in_docs = [None, *found], docs[lang, source]
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
                numbers = [pa.array([0, *found.values()], pa.int64()), pa.array([0, *map(in_docs.__getitem__, found)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, pa.array([None, *found], pa.binary()).cast(pa.string()), *numbers], ["lang", "source", "term", "c", "docs"])
            times.clear()
            docs.clear()

        for batch in batches:
            langs, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for r in range(batch.num_rows):
                terms = batch.column(1)[r].as_buffer().to_pybytes().translate(SPLIT_AND_LOWER).split()
                found = Counter(terms) if len(copies[r]) > 1 or copies[r][0]["n"] > 1 else None
                for copy in copies[r]:
                    group, n = (langs[r], copy["source"]), copy["n"]
                    held -= len(times[group])
                    if found is None:
                        times[group].update(terms)
                        docs[group].update(set(terms))
                    else:
                        times[group].update({t: n * c for t, c in found.items()})
                        docs[group].update(dict.fromkeys(found, n))
                    held += len(times[group])
                if held >= most_held:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    rows = texts.select("lang", "text", "copies").mapInArrow(added, "lang string, source string, term string, c bigint, docs bigint")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """Rows of terms that enough documents of the language hold, with the language's count, and the rows that name groups; `head` is 1 in one row a term."""
    whole_lang = Window.partitionBy("lang", "term")
    rows = counts.withColumn("in_docs", F.sum("docs").over(whole_lang)).withColumn("in_lang", F.sum("c").over(whole_lang))
    rows = rows.withColumn("head", (F.row_number().over(whole_lang.orderBy("source")) == 1).cast("int"))
    return rows.where((F.col("in_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "c", "in_lang", "head")


def histogram(kept: DataFrame) -> DataFrame:
    """(lang, source, c, n): how many kept terms a source has c times; heads: of these, the rows that stand for their term."""
    return kept.groupBy("lang", "source", "c").agg(F.count("*").alias("n"), F.sum("head").alias("heads"))


def totals(counts: DataFrame, by_count: DataFrame) -> DataFrame:
    """Each group: (lang, source, total N, n_kept rows, terms V of the language, lang_total, p0 the share of a term that it lacks; null if V is 0)."""
    found = by_count.groupBy("lang", "source").agg(F.sum(whole(F.col("c")) * F.col("n")).cast("long").alias("total"), F.sum("n").alias("n_kept"), F.sum("heads").alias("heads"))
    groups = counts.where("term is null").select("lang", "source").join(found, ["lang", "source"], "left").na.fill(0, ["total", "n_kept", "heads"])
    by_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", "n_kept", F.sum("heads").over(by_lang).alias("terms"), F.sum("total").over(by_lang).alias("lang_total"))
    return groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms")))


def shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, p, q, p0): each kept term's share in a source that has it, and in the language."""
    rows = join_hot(kept, groups, ["lang", "source"], "n_kept", kept.count())
    p, q = share(F.col("c"), F.col("total"), F.col("terms")), share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    return rows.select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0")


def term_part(rows: DataFrame, ranks: int) -> DataFrame:
    """The terms that a source has more of than its language, the most divergent ones."""
    rows = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def pair_part(rows: DataFrame, by_count: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language and its divergence. What is added up is of type long, in two halves, so that no sum overflows."""
    left = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "total", "p0")], "terms")
    right = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "total", "p0")])
    pairs = left.join(right, "lang").where("source_a <> source_b")
    p0, q0 = F.col("p0_a"), F.col("p0_b")
    base = pairs.select("lang", "source_a", "source_b", F.coalesce(whole(F.col("terms")) * whole(apart(p0, q0)), F.lit(0)).alias("part"))
    own = by_count.select("lang", F.col("source").alias("source_a"), "c", "n").join(pairs, ["lang", "source_a"])
    own = own.withColumn("part", whole(F.col("n")) * whole(apart(share(F.col("c"), F.col("total_a"), F.col("terms")), q0) - apart(p0, q0)))
    other = by_count.select("lang", F.col("source").alias("source_b"), "c", "n").join(pairs, ["lang", "source_b"])
    other = other.withColumn("part", whole(F.col("n")) * whole(apart(p0, share(F.col("c"), F.col("total_b"), F.col("terms"))) - apart(p0, q0)))
    a, b = (rows.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab")
    p, q = F.col("p_a"), F.col("p_b")
    both = a.join(b, ["lang", "term"]).where("source_a <> source_b")
    both = both.withColumn("part", apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(F.shiftright("part", 24)).alias("high"), F.sum(F.col("part").bitwiseAND(F.lit(2**24 - 1))).alias("low"))
    both = both.withColumn("part", whole(F.col("high")) * 2**24 + whole(F.col("low")))
    names = ("lang", "source_a", "source_b", whole(F.col("part")).alias("part"))
    parts = base.select(*names).union(own.select(*names)).union(other.select(*names)).union(both.select(*names))
    sums = parts.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("part").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the source's own terms to `ranks`."""
    counts = store(kept_terms(occurrences(collapsed(docs, text, lang, source)), least_docs), "terms")
    kept = counts.where("term is not null")
    by_count = store(histogram(kept), "histogram")
    groups = store(totals(counts, by_count), "groups")
    rows = store(shares(kept, groups), "shares")
    drop_stored(docs.sparkSession, counts)
    return pair_part(rows, by_count, groups).union(term_part(rows, ranks))
