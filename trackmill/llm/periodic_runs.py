"""Periodic runs of words and their collapse to one period, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
`least_words` and `least_times` * q long (4 or more times), that no neighbouring word extends. Collapsing drops the words that
a run holds after its first q.

How, for a text of n words: a suffix array by prefix doubling keeps the rank of every block of 1, 2, 4, ... words; equal blocks
are an interval of the suffix array. A wavelet matrix over the array answers range successor: the nearest occurrence of a
block after or before a place. Every dyadic block (m words, at a multiple of m) asks for its occurrences in
the windows of m words behind and ahead. Those form an arithmetic progression with the block's period, so the nearest one on either side gives the
difference; it is a candidate if it is over m / 2 and at most m. A run of period q, m / 2 < q <= m, of four
periods or more holds such a block together with a neighbour q away, and none nearer: its period is found. Candidates are
extended to both sides by comparing ranks of blocks of falling size; equal runs are found many times and kept once.

Workers handle texts together, as one sequence with a separate alphabet for each text, so that no block reaches over a
text's end: about `together` words at a time, a longer text alone. Memory grows with the longest text, not with
a portion: some 100 bytes a word, 200 for a text that is one long repetition. There is no shuffle.

Defined results: null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows give equal
results; an empty table gives an empty result; all rows and columns are kept (one named like the result is replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import bind, words

RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled(codes: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of codes, sorted by blocks of up to `longest` words, and the ranks of all blocks of 1, 2, 4, ... words.

    A rank is the number of suffixes that begin with a smaller block. The last code must occur once.
    """
    n = len(codes)
    before = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    ranks = [before[codes].astype(np.int64)]
    order = np.argsort(ranks[0], kind="stable")
    sizes = np.bincount(ranks[0], minlength=n)
    at = order[sizes[ranks[0][order]] > 1]
    step = 1
    while len(at) and 2 * step <= longest:
        now = ranks[-1]
        keys = now[at] * n + now[at + step]
        by = np.argsort(keys, kind="stable")
        keys, at = keys[by], at[by]
        first = now[at]
        place = np.arange(len(at))
        begins = np.concatenate([[True], first[1:] != first[:-1]])
        offset = place - np.maximum.accumulate(np.where(begins, place, 0))
        differs = np.concatenate([[True], keys[1:] != keys[:-1]])
        order[first + offset] = at
        nxt = now.copy()
        nxt[at] = (first + offset)[np.maximum.accumulate(np.where(differs, place, 0))]
        ranks.append(nxt)
        alone = differs & np.concatenate([differs[1:], [True]])
        at = at[~alone]
        step *= 2
    return order, ranks


class Successors:
    """A wavelet matrix: the k-th smallest value of a range, and how many values of a range are smaller than one, for many ranges at once."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero, dtype=np.int32)])))
            values = np.concatenate([values[zero], values[~zero]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        total = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = (than >> bit) & 1 == 1
            total += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return total

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value


def candidates(order: np.ndarray, ranks: list[np.ndarray], own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): dyadic blocks and the distance to their nearest neighbour, if it is over half a block and at most a block.

    own: each place's number within its text; blocks that are equal are of one text.
    """
    n = len(order)
    nearest = Successors(own[order], bits)
    blocks, sizes, low, high = [], [], [], []
    for k, rank in enumerate(ranks):
        at = np.arange(0, n, 2**k)
        much = np.bincount(rank, minlength=n)[rank[at]]
        at, much = at[much > 1], much[much > 1]
        blocks.append(at)
        sizes.append(np.full(len(at), 2**k))
        low.append(rank[at])
        high.append(rank[at] + much)
    at, m, low, high = (np.concatenate(x) for x in (blocks, sizes, low, high))
    here = own[at]
    k = nearest.smaller(low, high, here)
    places, periods = [], []
    for side in (1, -1):
        some = (k + 1 < high - low) if side > 0 else k > 0
        found = nearest.kth(low[some], high[some], k[some] + side)
        apart = side * (found - here[some])
        near = (apart <= m[some]) & (2 * apart > m[some])
        places.append((at[some] + np.minimum(0, side * apart))[near])
        periods.append(apart[near])
    return np.concatenate(places), np.concatenate(periods)


def extended(ranks: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretch around [at, at + period] in which places a period apart have equal codes."""
    ahead, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[k], 2**k
        more = np.ones(len(at), bool)
        while more.any():  # once but for the largest blocks
            i = at + ahead
            more = rank[i] == rank[i + period]
            ahead += step * more
            if k < len(ranks) - 1:
                break
        more = np.ones(len(at), bool)
        while more.any():
            i = at - back - step
            more = (i >= 0) & (rank[np.maximum(i, 0)] == rank[np.maximum(i, 0) + period])
            back += step * more
            if k < len(ranks) - 1:
                break
    return at - back, at + period + ahead


def runs_of(texts: list[list[bytes]], least_words: int, least_times: int) -> list[np.ndarray]:
    """The runs of each text, as rows (start, length, period) in order of start and period."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(starts[-1])
    codes = np.empty(n, np.int64)
    used = 0
    for t, s in zip(texts, starts, strict=False):
        ids = defaultdict(count(used).__next__)
        codes[s : s + len(t)] = np.fromiter(map(ids.__getitem__, t), np.int64, len(t))
        used += len(ids)
        codes[s + len(t)] = used  # a code of its own ends each text
        used += 1
    longest = int(sizes.max())
    order, ranks = doubled(codes, max(1, longest // 2))
    own = np.arange(n) - np.repeat(starts[:-1], sizes + 1)
    at, period = candidates(order, ranks, own, max(1, (longest + 1).bit_length()))
    start, end = extended(ranks, at, period)
    long = (end - start >= least_times * period) & (end - start >= least_words)
    found = np.unique(np.stack([start[long], end[long] - start[long], period[long]], 1), axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    of = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[of]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def collapsed(text: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(text)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(text, np.cumsum(change[:-1]) == 0))


def find(docs: DataFrame, text: str = "text", result: str = "periodic", least_words: int = 6, least_times: int = 4, together: int = 65_536) -> DataFrame:
    """All rows and columns of docs with a struct `result`: n_words, runs (start, length, period, in order of start and period), collapsed text."""
    if least_times < 4:
        raise ValueError("runs of fewer than four periods are not found")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            size = np.array(column.cast(pa.binary()).is_valid()) * np.diff(np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1, 4 * column.offset)) if batch.num_rows else np.zeros(0)
            by_size = np.argsort(size, kind="stable")  # texts of like length go together
            portion: list[int] = []
            chars = 0
            for r in by_size:
                portion.append(int(r))
                chars += int(size[r])
                if chars >= 6 * together or len(portion) >= together:
                    yield answered(batch, column, portion)
                    portion, chars = [], 0
            if portion:
                yield answered(batch, column, portion)

    def answered(batch: pa.RecordBatch, column: pa.Array, rows: list[int]) -> pa.RecordBatch:
        texts = [column[r].as_buffer().to_pybytes().split() if column[r].is_valid else [] for r in rows]
        runs = runs_of(texts, least_words, least_times)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
        flat = np.concatenate(runs)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(RUN)))
        short = pa.array([collapsed(t, x) for t, x in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
        made = pa.StructArray.from_arrays([pa.array([len(t) for t in texts], pa.int64()), listed, short], ["n_words", "runs", "collapsed"])
        part = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, result])

    kept = docs.drop(result)
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{result}` {RESULT}"])
    return kept.mapInArrow(found, fields)


def planted(key: Column, text: Column) -> Column:
    """The text as words joined by spaces, in a tenth of the documents, chosen by the key, with a stretch that repeats itself to the end."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(bind(words(text), repeated), " ")).otherwise(text)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, n_runs, the run with the greatest length / period (first of the equal ones), digests of all runs and of the collapsed text."""
    given = docs.select(F.col(f"`{key}`").alias(key), planted(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("text"))
    p = find(given).select(key, "periodic.*")
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    p = p.withColumn("best", best)
    return p.select(
        key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
