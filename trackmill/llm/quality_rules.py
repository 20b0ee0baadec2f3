"""Weak supervision over document quality rules, in DataFrame functions only.

Nine rules vote good (+1), bad (-1) or abstain (0) on a document. Kinds of junk differ, and each is seen by one
or two rules, so the generative model has a class of good documents and a kind of junk for each rule. The shares of
the classes and, per rule, the chance of each vote given the class (its false alarm rate among them) are fitted by
expectation-maximisation on the counts of distinct vote patterns (at most 3**9 rows whatever the
corpus size). A document is kept if the posterior probability of the good class reaches a threshold.

Defined results: a null text has no words; an empty text fails the base rules; repeated rows are
judged one by one and alike; an empty table gives an empty result; extra columns of the input are
carried through (one named like the result is replaced), and the derived columns live in one struct so that no name can clash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import bind, store, words

WINDOW = 8
RULES = ("length", "word_shape", "symbols", "marks", "dup_lines", "repeats", "capitals", "variety", "sentences")


def covered_by_repeats(ws: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words (a power of two) that occur at least twice in the row.

    ws: the hashes of the row's words.

    The windows of a row are hashed (64 bits); rows without an equal pair of hashes, nearly all,
    end there. Else (hash, start) is sorted, starts that share a hash are kept and the union of
    their windows is measured. Time is n log n in the words of a row.
    """
    zero = F.lit(0).cast("long")

    def measure(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            n = F.size(p)
            same = lambda k, j: F.get(p, k)["h"].eqNullSafe(F.get(p, j)["h"])
            return F.sort_array(
                F.transform(
                    F.filter(p, lambda x, k: ((k > 0) & same(k, k - 1)) | ((k < n - 1) & same(k, k + 1))),
                    lambda x: x["i"],
                )
            )

        return bind(
            bind(pairs, starts),
            lambda s: F.aggregate(
                s,
                F.struct(zero.alias("n"), F.lit(-width).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).cast("long").alias("n"), i.alias("last")),
                lambda a: a["n"],
            ),
        )

    def doubled(step: int):
        """Hashes of runs twice as long, from those of runs of `step`; past the end: fewer words."""
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def per_row(w: Column) -> Column:
        out, step = w, 1
        while step < width:
            out = bind(out, doubled(step))
            step *= 2
        out = F.slice(out, 1, F.size(w) - (width - 1))
        return F.when(F.size(w) < width + 1, zero).otherwise(
            bind(out, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(measure(h)))
        )

    return per_row(ws)


def features(text: Column) -> Column:
    """A struct of exact counts over the whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def letters(pattern: str) -> Column:
        """Characters that match; the pattern is of those that don't."""
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def of(w: Column) -> Column:
        """w: the words' 64-bit hashes; equal words have equal hashes."""
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            letters(r"[\x20\x09-\x0D]+").alias("word_chars"),
            letters(r"[^#*$%&|<>]+").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            bind(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            covered_by_repeats(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            letters("[^A-Z]+").alias("n_capitals"),
            (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("long").alias("n_stops"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        )

    return bind(F.transform(words(text), lambda x: F.xxhash64(x)), of)


def votes(f: Column, min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """The rules' votes as a string of one letter a rule: g good, b bad, a abstains."""
    n = f["n_words"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, "b").when(good, "g").otherwise("a")

    short = n < min_words
    per_word = f["word_chars"] / F.greatest(n, F.lit(1))
    return F.concat(
        vote(short, n >= 2 * min_words),
        vote((per_word < 2) | (per_word > 14), (per_word >= 3) & (per_word <= 10)),
        vote(f["n_symbols"] * 5 > n, f["n_symbols"] * 20 <= n),
        vote((f["n_symbols"] + f["n_marks"]) * 4 > n, (f["n_symbols"] + f["n_marks"]) * 20 <= n),
        vote(f["n_dup_lines"] * 2 > f["n_lines"], f["n_dup_lines"] * 10 <= f["n_lines"]),
        vote(f["n_repeat_words"] * 100 > n * max_repeat_percent, f["n_repeat_words"] * 10 <= n),
        vote(f["n_capitals"] * 2 > f["word_chars"], f["n_capitals"] * 5 <= f["word_chars"]),
        F.when(short, "a").otherwise(vote((n < 400) & (f["n_distinct"] * 5 < n), f["n_distinct"] * 10 >= n * F.when(n < 400, 4).otherwise(1))),
        F.when(short, "a").otherwise(vote(f["n_stops"] * 100 < n, f["n_stops"] * 40 >= n)),
    )


def fit(patterns: list[tuple[str, int]], rounds: int = 60, prior: float = 0.9) -> tuple[list[float], list[list[dict[str, float]]]]:
    """Expectation-maximisation over (pattern, count) rows.

    Returns the shares of the classes, good documents first, then a kind of junk for each rule, and, per
    rule and class, the chance of each vote: chances of "b" in the first class are the rules' false alarm rates.
    Nothing is held fixed; the start gives each class its meaning (a kind's own rule sees nine in ten of it), counts are
    smoothed by one. Without documents the start comes back.
    """
    k = len(RULES)
    share = [prior, *[(1 - prior) / k] * k]
    table = [[{"g": 0.88, "b": 0.02, "a": 0.1} if c == 0 else {"g": 0.1, "b": 0.8, "a": 0.1} if c == j + 1 else {"g": 0.7, "b": 0.2, "a": 0.1} for c in range(k + 1)] for j in range(k)]
    for _ in range(rounds if patterns else 0):
        seen = [[dict.fromkeys("gba", 1.0) for _ in range(k + 1)] for _ in range(k)]
        total = [1.0] * (k + 1)
        for pattern, count in patterns:
            for c, p in enumerate(posterior(share, table, pattern)):
                total[c] += count * p
                for j, v in enumerate(pattern):
                    seen[j][c][v] += count * p
        before, share = share, [t / sum(total) for t in total]
        table = [[{v: n / sum(votes_.values()) for v, n in votes_.items()} for votes_ in rule] for rule in seen]
        if max(abs(a - b) for a, b in zip(before, share, strict=True)) < 1e-9:
            break
    return share, table


def posterior(share: list[float], table: list[list[dict[str, float]]], pattern: str) -> list[float]:
    """Probabilities of the classes given a vote pattern; abstaining says nothing."""
    logs = [math.log(q) + sum(math.log(t[c][v]) for t, v in zip(table, pattern, strict=True) if v != "a") for c, q in enumerate(share)]
    top = max(logs)
    odds = [math.exp(x - top) for x in logs]
    return [x / sum(odds) for x in odds]


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, result: str = "quality", keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs (without the text, if keep_text is false) with a struct `result`: the counts, base_failed, votes, posterior and kept.

    The counts of each row are made once and stored with the row in the shared folder; the votes
    are counted from there (the only aggregation, of at most 3**9 rows) and the verdicts added.
    Select beforehand the columns that are wanted. Nothing is shuffled but pattern counts.
    """
    needed = [c for c in docs.columns if (c != text or keep_text) and c != result]
    marked = store(docs.select(*[F.col(f"`{c}`") for c in needed], features(F.col(f"`{text}`")).alias("__f")), "quality")
    counted = [(r[0], r[1]) for r in marked.groupBy(votes(F.col("__f")).alias("v")).count().collect()]
    model = fit(sorted(counted))
    good = json.dumps({pattern: posterior(*model, pattern)[0] for pattern, _ in counted})
    # one row a pattern, at most 3**9 of them
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(good), "map<string,double>")).alias("__v", "__p"))
    f = F.col("__f")
    failed = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
    judged = marked.select("*", votes(f).alias("__v"), failed.alias("__failed")).join(F.broadcast(table), "__v")
    return judged.select(
        *[F.col(f"`{c}`") for c in needed],
        F.struct(
            "__f.n_words", "__f.word_chars", "__f.n_symbols", "__f.n_dup_lines", "__f.n_repeat_words",
            F.col("__failed").alias("base_failed"), F.col("__v").alias("votes"), F.col("__p").alias("posterior"),
            (~F.col("__failed") & (F.col("__p") >= threshold)).alias("kept"),
        ).alias(result),
    )
