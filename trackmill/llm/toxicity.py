"""Toxicity of documents after noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Words that may be disguised (letters
mixed with digits or symbols, letters repeated three times or more, three or more single letters, digits
or signs in a row with separators between) become a lattice: each sign may stand for itself, for the letters it resembles,
or for nothing. Viterbi search under the character model and the channel's costs restores the most
likely word. Restored words and the plain ones are then scored by a lexicon of words and word
beginnings, whose weights are log odds between toxic and other labelled documents.

The lexicon is learnt from a bounded sample: at most `per_label` labelled rows of each label, those
with the smallest hash of their id. Its parts score each other by lexicons that leave them out, and a
logistic curve fitted to these scores turns a text's summed weights into a chance. Everything else
covers all rows and whole texts.

Defined results: null and empty texts have the score of a document without any sign of toxicity;
labels with null are ignored; a document labelled twice counts as toxic if one label says so; without toxic labels
every score is 0; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import in_bucket, store

#: What a sign may stand for (fixed values).
RESEMBLES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*'"
#: Classes of the character model: 0 anything else, 1-26 letters, 27 bytes beyond ASCII.
CLASSES = 28
UNIT = rf"(?:[^\W_]|[{re.escape(''.join(c for c in RESEMBLES if not c.isalnum()))}])"
GAP = rf"[{re.escape(SEPARATORS)}]"
#: Single letters, digits or signs with separators between, no part of a longer word; those of letters alone; longer gaps.
SPACED = re.compile(rf"(?<![^\W_]){UNIT}(?:{GAP}+{UNIT}){{2,}}(?![^\W_])")
LETTERS = re.compile(rf"[^\W\d_](?:{GAP}+[^\W\d_]){{2,}}")
LONG_GAP = re.compile(rf"{GAP}{{2,}}")
REPEATED = re.compile(r"(.)\1\1")
EDGE = ".,;:?!\"'()[]{}#%&*$|<>-"
PREFIXES = (4, 5, 6)
KEPT = 300_000


def class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[128:] = 27
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i + 1
    return t


def letter_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of character trigrams over all texts; a task sends each of the at most 28**3 kinds once."""

    def rows(batches):
        table, seen = class_table(), np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    c = table[np.frombuffer(f"  {x} ".encode("utf-8", "replace"), np.uint8)]
                    seen += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["k", "n"])

    out = np.zeros(CLASSES**3)
    for k, n in df.select(text).mapInArrow(rows, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class given the two before it, smoothed by the pair and the single class."""
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES)
    c1 = c3.sum((0, 1)) + 1
    p1 = c1 / c1.sum()
    c2 = c3.sum(0)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5))


def classes_of(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ord(ch) > 127 else 0


def restore(span: str, model: np.ndarray, swap: float = 1.0, skip: float = 0.7, keep: float = 4.0) -> str:
    """The most likely word behind a disguised one: Viterbi over the last two characters.

    A sign costs `swap` as a letter it resembles, `skip` as nothing if it separates or repeats the
    sign before, and `keep` as itself.
    """
    best: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
    before = ""
    for ch in span.lower():
        options = [(x, swap) for x in RESEMBLES.get(ch, "")]
        if ch.isalpha():
            options.append((ch, 0.0))
        elif ch not in SEPARATORS:
            options.append((ch, keep))
        if ch in SEPARATORS or ch == before:
            options.append(("", 0.0 if ch in SEPARATORS else skip))
        before = ch
        new: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (cost, trail) in best.items():
            for x, extra in options:
                if x:
                    state, total, path = (b, x), cost + extra - model[classes_of(a), classes_of(b), classes_of(x)], (trail, x)
                else:
                    state, total, path = (a, b), cost + extra, trail
                if state not in new or total < new[state][0]:
                    new[state] = (total, path)
        best = new
    ends = {s: (c - model[classes_of(s[0]), classes_of(s[1]), 0], t) for s, (c, t) in best.items()}
    trail, letters = min(ends.values(), key=lambda x: x[0])[1], []
    while trail:
        trail, x = trail
        letters.append(x)
    return "".join(reversed(letters))


def disguised(word: str) -> bool:
    """Letters together with signs that resemble letters, or a letter three times in a row."""
    if word.isalpha():
        return bool(REPEATED.search(word))
    return any(c.isalpha() for c in word) and (any(c in RESEMBLES for c in word) or bool(REPEATED.search(word)))


def spaced(text: str) -> set[str]:
    """What may be one disguised word each: runs of single signs, their parts between longer gaps, those
    without a sign at either end (it may belong to the sentence), and the letters in a row."""
    out: set[str] = set()
    for span in SPACED.findall(text):
        for part in {span, *LONG_GAP.split(span)}:
            units = [c for c in part if c not in SEPARATORS]
            edged = part.strip(EDGE + SEPARATORS)
            for form in ("".join(units), "".join(units[1:]), "".join(units[:-1]), "".join(c for c in edged if c not in SEPARATORS)):
                out.add(form)
            out.update("".join(c for c in x if c not in SEPARATORS) for x in LETTERS.findall(part))
    return {x for x in out if len(x) > 2 and any(c.isalpha() for c in x)}


def terms(word: str) -> list[str]:
    """What a word is looked up as: itself, and its beginnings."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


class Reader:
    """The terms of a text, plain and restored; words are looked up once and kept, up to KEPT of them."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float] | None = None):
        self.model, self.lexicon = model, lexicon
        self.known: dict[str, tuple[str, ...]] = {}

    def of_word(self, raw: str) -> tuple[str, ...]:
        word = raw.strip(EDGE)
        found = terms(word) if word else []
        for form in {raw, word}:
            if disguised(form):
                plain = restore(form, self.model)
                found += terms(plain)
                if REPEATED.search(form):
                    found += terms(REPEATED_RUN.sub(r"\1", plain))
        return tuple(f for f in dict.fromkeys(found) if self.lexicon is None or f in self.lexicon)

    def signs(self, text: str) -> set[tuple[str, ...]]:
        """The distinct signs of a text, each as the terms it is looked up as."""
        low = text.lower()
        out: set[tuple[str, ...]] = set()
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for w in set(low.split()):
            got = known.get(w)
            if got is None:
                got = known[w] = self.of_word(w)
            if got:
                out.add(got)
        for span in spaced(low):
            got = tuple(t for t in terms(restore(span, self.model)) if self.lexicon is None or t in self.lexicon)
            if got:
                out.add(got)
        return out

    def terms(self, text: str) -> set[str]:
        return {t for sign in self.signs(text) for t in sign}


def evidence(signs: set[tuple[str, ...]], lexicon: dict[str, float]) -> float:
    """The summed weights of the distinct terms that are the strongest of a sign: a word and its
    beginnings are one sign, so that no word counts more than once."""
    best = {max(known, key=lambda t: (lexicon[t], t)) for sign in signs if (known := [t for t in sign if t in lexicon])}
    return sum(lexicon[t] for t in sorted(best))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of the chance that y is 1, given x, of points that occur n times each: Newton steps, with a
    weak normal prior around the share of ones and a slope of 1, which separable data need."""
    n = np.ones(len(x)) if n is None else n
    start = np.array([math.log(((n * y).sum() + 0.5) / ((n * (1 - y)).sum() + 0.5)), 1.0])
    b, rows = start.copy(), np.stack([np.ones(len(x)), x], 1)

    def cost(b):
        z = rows @ b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + ((b - start) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -60, 60)))
        slope = rows.T @ (n * (p - y)) + (b - start)
        step = np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and cost(b - size * step) > cost(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(b[0]), max(float(b[1]), 0.0)


REPEATED_RUN = re.compile(r"(.)\1+")


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str, text: str, label: str, per_label: int, held_out_of: int, odds: float = 2.5, parts: int = 4) -> tuple[dict[str, float], float, float]:
    """The lexicon (term -> log odds; the sample bounds it), and intercept and slope of the log odds of a document by its evidence.

    Of copies in the sample one counts: rows of a label whose long words have the same four smallest hashes.
    A term with t toxic and c other documents is taken if so uneven a split would not be expected
    once by chance among all terms, by the entropy bound on the number of splits. The sample is
    dealt into `parts` parts by hash; the curve is fitted to the evidence that each row has by the lexicon of the other
    parts, as rows look stronger by a lexicon that they made. Its intercept is moved from the
    sample's share of toxic rows to that of all labelled rows that may be learnt from.
    """
    seen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    seen = seen.where(in_bucket(F.col(key), held_out_of) != 0)
    dealt = F.xxhash64(F.lit("sample"), F.col(key))
    sample = None
    for y in (0, 1):
        part = seen.where((F.col("__y") > 0) if y else (F.col("__y") <= 0)).orderBy(dealt, key).limit(per_label).select(key, F.lit(y).alias("__y"))
        sample = part if sample is None else sample.union(part)
    picked = docs.select(key, text).join(F.broadcast(sample), key)

    long_words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: F.length(w) >= 6)
    own = F.slice(F.array_sort(F.array_distinct(F.transform(long_words, lambda w: F.xxhash64(w)))), 1, 4)
    own = F.when(F.size(own) == 4, F.xxhash64(own)).otherwise(F.xxhash64(key))
    picked = picked.select(text, "__y", own.alias("__own")).dropDuplicates(["__y", "__own"])
    picked = store(picked.select(text, "__y", F.pmod("__own", F.lit(parts)).cast("int").alias("__part")), "labelled")
    sizes = {(r["__part"], r["__y"]): r["n"] for r in picked.groupBy("__part", "__y").agg(F.count("*").alias("n")).collect()}
    everyone = seen.agg(F.count("*"), F.sum((F.col("__y") > 0).cast("long"))).first()
    share = ((everyone[1] or 0) + 0.5) / (everyone[0] + 1)
    whole = tuple(sum(n for (_, y), n in sizes.items() if y == want) for want in (1, 0))
    if not whole[0]:
        return {}, -math.inf, 0.0

    def rows(batches):
        reader = Reader(model)
        for batch in batches:
            found = [(t, y, p) for x, y, p in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True) for t in reader.terms(x or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["term", "y", "part"])

    y = F.col("y")
    by_part = [f(v).alias(f"{c}{k}") for k in range(parts) for c, v, f in (("t", F.when(F.col("part") == k, y).otherwise(0), F.sum), ("c", F.when(F.col("part") == k, 1 - y).otherwise(0), F.sum))]
    counted = picked.mapInArrow(rows, "term string, y int, part int").groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - y).alias("c"), *by_part)
    counted = store(counted.where("t > 1"), "terms")
    chance = math.log(counted.count() or 1) + 3

    def weight(t, c, n_t: int, n_c: int):
        """The term's log odds, null where it isn't taken."""
        w = F.log((t + 0.5) / (n_t + 1.0)) - F.log((c + 0.5) / (n_c + 1.0))
        q = t / F.greatest(t + c, F.lit(1))
        splits = -(t + c) * (q * F.log(q) + F.when(q < 1, (1 - q) * F.log(1 - q)).otherwise(0.0))
        unlikely = t * -math.log((n_t + 0.5) / (n_t + n_c + 1)) + c * -math.log((n_c + 0.5) / (n_t + n_c + 1)) - splits > chance
        return F.when((t > 1) & (w >= odds) & unlikely, w)

    without = [weight(F.col("t") - F.col(f"t{k}"), F.col("c") - F.col(f"c{k}"), whole[0] - sizes.get((k, 1), 0), whole[1] - sizes.get((k, 0), 0)).alias(f"w{k}") for k in range(parts)]
    taken = counted.select("term", weight(F.col("t"), F.col("c"), *whole).alias("w"), *without)
    taken = taken.where(F.coalesce("w", *[f"w{k}" for k in range(parts)]).isNotNull()).collect()
    lexicons = [{r["term"]: r[f"w{k}"] for r in taken if r[f"w{k}"] is not None} for k in range(parts)]

    def weighed(batches):
        reader = Reader(model)
        for batch in batches:
            texts, ys, ps = (batch.column(k).to_pylist() for k in range(3))
            xs = [evidence(reader.signs(x or ""), lexicons[p]) for x, p in zip(texts, ps, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["x", "y"])

    points = picked.mapInArrow(weighed, "x double, y double").groupBy("x", "y").agg(F.count("*").alias("n")).collect()  # at most the sample's rows
    at, slope = logistic(*np.array(sorted((p["x"], p["y"], p["n"]) for p in points), float).T)
    at += math.log(share / (1 - share)) - math.log((whole[0] + 0.5) / (whole[1] + 0.5))
    return {r["term"]: r["w"] for r in taken if r["w"] is not None}, at, slope


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 6000, held_out_of: int = 5) -> DataFrame:
    """Per document: key, held_out, score, predicted.

    The score is the chance of toxicity by the fitted curve over the text's `evidence`. Two passes over the texts; shuffled are trigram
    kinds and the sample's terms. The model and lexicon sent to the workers are bounded by 28**3
    numbers and the terms of the sample.
    """
    model = letter_model(letter_counts(docs, text)).astype(np.float32)
    lexicon, at, slope = learn(docs, labels, model, key, text, label, per_label, held_out_of)

    def rows(batches):
        reader = Reader(model, lexicon)
        for batch in batches:
            scores = []
            for x in batch.column(1).to_pylist():
                log = at + slope * evidence(reader.signs(x or ""), lexicon)
                scores.append(0.0 if log == -math.inf else 1 / (1 + math.exp(-max(-60.0, min(60.0, log)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    picked = docs.select(key, text)
    out = picked.mapInArrow(rows, f"`{key}` {picked.schema[0].dataType.simpleString()}, score double")
    return out.select(key, (in_bucket(F.col(key), held_out_of) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
