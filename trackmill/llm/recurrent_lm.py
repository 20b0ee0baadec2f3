"""Scoring documents by a gated recurrent language model with a class-factored softmax, in numpy.

Vocabulary: the most frequent words of the training texts have inputs and outputs of their own: `head`
words in `classes` classes at least, and eight times the cube root of the training tokens in as many
classes as the root of half that number, where that is more (so that the weights, which are broadcast, stay within
tens of megabytes at thousands of billions of tokens). All other words share an output class by their
shape (last byte, ASCII or not; rare shapes share one), and their inputs share hash buckets.
p(word) = p(class | state) * p(word | class, state) for head words, whose classes hold about equal
shares of the tokens; and p(class | state) * (c + a) / (sum of c + a of the class) for the others,
with c a word's count in the training texts and one further word, never seen, in each class.
The output biases start at the counts, so the untrained network is the smoothed unigram model.

Training covers every training text once, with the loss at every token, in rounds over growing parts of the corpus: each task starts from the
last average, carries the state from window to window of a document, back-propagates
within the window (truncated) and sends its weights, which are averaged over tasks in a stream.
Scoring carries the state through whole documents.

Documents lie end to end in lanes, the state beginning anew with each, so that a step has many tokens
whatever the longest document is. Training depends on how rows are dealt to tasks, so scores of two runs
may differ a little; base scores and counts don't.

Words are counted as (word, chunk) rows, a chunk being a run of stored rows of at most `chunk_bytes` of text
(a longer text is one alone); totals go back to the chunks, and each chunk's texts meet the counts of their
own words alone. That pass turns documents into codes, which training and scoring read. Words are counted by 64-bit numbers, random
sums over their bytes; two of a billion words share one with a chance of about one in forty. Broadcast are the weights and the
head words, which grow with the cube root of the tokens.

Defined results: null and empty texts are one end token; a null id counts as the empty text when
documents are dealt to training; repeated rows train and score each; without training texts all words are unknown
and scores come from the constants alone; an empty table gives an empty result.
"""

from __future__ import annotations

from ctypes import CDLL
from heapq import heapreplace
from math import isqrt
from os import path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import drop_stored, in_bucket, store

ADD = 0.1
END = 0  # the number of the end token
SHAPES, BUCKETS = 64, 512
LANES, WINDOW, PORTION, ROWS = 512, 32, 4_000_000, 1024
#: Partitions of a shuffle by chunks at most.
MOST_PARTS = 20_000


def one_blas_thread() -> None:
    """A task has one core: products of small matrices gain nothing from more threads, which would wait in busy loops."""
    if not _limited:
        _limited.append(True)
        libraries = {line.split()[-1] for line in open("/proc/self/maps") if "openblas" in line} if path.exists("/proc/self/maps") else ()
        for at in libraries:
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if found := getattr(CDLL(at), name, None):
                    found(1)
                    break


_limited: list[bool] = []


def shape_table() -> np.ndarray:
    t = np.full(256, 31)
    t[ord("a") : ord("z") + 1] = t[ord("A") : ord("Z") + 1] = np.arange(26)
    t[ord(".")], t[ord(",")], t[ord("!")], t[ord("|")] = 26, 27, 28, 29
    t[ord("0") : ord("9") + 1] = 30
    t[128:] = np.arange(128) % 32  # continuation bytes say what letter a word ends in
    return t


_shapes = shape_table()
_random = np.random.default_rng(20240601)
#: A random number for each byte (A-Z as a-z) and for each place in a word: a word's number is the sum of their products, mixed.
_byte, _place = (_random.integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1) for n in (256, 1 << 16))
_byte[ord("A") : ord("Z") + 1] = _byte[ord("a") : ord("z") + 1]
_byte[[32, *range(9, 14)]] = 0  # white space adds nothing to the word before it


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts: 64-bit numbers of the words and of the end after each text, their shapes, and where each text ends."""
    binary = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, 8 * binary.offset)
    data = np.frombuffer(binary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if binary.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    numbers, shapes, counts = [], [], []
    first = 0
    while first < len(binary):  # what stays in the processor's cache, or one longer text
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 200_000, side="right")) - 1)
        b, borders = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        solid = (b != 32) & (b - np.uint8(9) > 4)
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        filled = borders[:-1] < borders[1:]
        begins[borders[:-1][filled]] = solid[borders[:-1][filled]]  # a text's first byte begins a word
        stops[borders[1:][filled] - 1] = solid[borders[1:][filled] - 1]
        starts, final = np.flatnonzero(begins), np.flatnonzero(stops)
        h, wide = np.zeros(0, np.uint64), np.zeros(len(starts), bool)
        if len(starts):
            b = b[starts[0] :]
            place = np.arange(starts[0], starts[0] + len(b)) - np.repeat(starts, np.diff(np.append(starts, starts[0] + len(b))))
            if (final - starts).max() > 0xFFFF:
                values = np.take(_place, place & 0xFFFF) + (place >> 16).astype(np.uint64) * np.uint64(2)
            else:
                values = np.take(_place, place, mode="clip")  # places beyond are white space
            values *= np.take(_byte, b, mode="clip")
            h = np.add.reduceat(values, starts - starts[0])
            wide[np.searchsorted(starts, starts[0] + np.flatnonzero(b >= 128), side="right") - 1] = True
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        own = np.searchsorted(starts, borders)
        ends = own[1:]
        numbers.append(np.insert(h.view(np.int64), ends, END))
        shapes.append(np.insert(_shapes[data[offsets[first] + final]] + 32 * wide, ends, 0).astype(np.uint8))
        counts.append(np.diff(own) + 1)
        first = last
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return join(numbers, np.int64), join(shapes, np.uint8), np.cumsum(join(counts, np.int64))


def distinct_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in the order they come in, where each comes first, and the place of each number among them."""
    found = pa.array(numbers).dictionary_encode()
    at = found.indices.to_numpy()
    return found.dictionary.to_numpy(), np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1)) if len(at) else at, at


def chunked(docs: DataFrame, most: int) -> DataFrame:
    """docs, whose uid rises along each task's rows, with a `chunk`: runs of rows of at most `most` bytes of text, or one longer row."""

    def rows(batches):
        task, chunk, filled = None, None, 0
        for batch in batches:
            found = []
            for u, n in zip(batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist(), strict=True):
                if u >> 33 != task or filled + n > most:  # a task's first row, or a full chunk
                    task, chunk, filled = u >> 33, u, 0
                filled += n + 64
                found.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "chunk"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(rows, f"{fields}, chunk bigint")


def chunk_words(stamped: DataFrame) -> DataFrame:
    """(word, chunk, n, shape): the words of each chunk, with n occurrences in its training texts, the end token with them."""

    def rows(batches):
        def send(chunk, parts):
            numbers, shapes, train = (np.concatenate(x) for x in zip(*parts, strict=True))
            words, first, at = distinct_of(numbers)
            n = np.bincount(at, train, len(words)).astype(np.int64)
            kept = (n > 0) | (words != END)
            return pa.RecordBatch.from_arrays([pa.array(words[kept]), pa.array(np.full(int(kept.sum()), chunk)), pa.array(n[kept]), pa.array(shapes[first][kept].astype(np.int32))], ["word", "chunk", "n", "shape"])

        chunk, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1)), len(chunks))
            for a, b in zip(cuts, cuts[1:]):
                if chunks[a] != chunk and parts:
                    yield send(chunk, parts)
                    parts = []
                chunk = chunks[a]
                numbers, shapes, ends = hashed(batch.column(2).slice(a, b - a))
                parts.append((numbers, shapes, np.repeat(~out[a:b], np.diff(ends, prepend=0))))
        if parts:
            yield send(chunk, parts)

    return stamped.select("chunk", "held_out", "text").mapInArrow(rows, "word bigint, chunk bigint, n bigint, shape int")


def totalled(found: DataFrame) -> DataFrame:
    """(chunk, word, c, shape, first): each row of a trained word with the word's count c in all chunks; first: once a word.

    One ordered pass in whole columns; what is held is one batch and the rows of the word that it ends in, one a chunk.
    """

    def rows(batches):
        def send(parts):
            words, chunks, n, shapes = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            c = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(n))))
            first = np.zeros(len(n), bool)
            first[starts] = True
            seen = c > 0
            return pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (chunks, words, c, shapes, first)], ["chunk", "word", "c", "shape", "first"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(4)]
            # the last word may go on in the next batch; all before it are complete
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield send([*held, [x[:cut] for x in columns]])
                held = []
            elif held and held[-1][0][-1] != columns[0][0]:
                yield send(held)
                held = []
            held.append([x[cut:] for x in columns])
        if held:
            yield send(held)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(rows, "chunk bigint, word bigint, c bigint, shape int, first boolean")


def vocabulary_size(total: int, head: int, classes: int) -> tuple[int, int]:
    """How many words have outputs of their own after `total` training tokens, and in how many classes; `head` and `classes` at least."""
    words = max(head, round(8 * total ** (1 / 3)))
    return words, max(classes, isqrt(words // 2))


class Vocabulary:
    """Head words with their classes, and the mass of each shape class."""

    def __init__(self, head: list[tuple[bytes, int]], mass: np.ndarray, total: int, distinct: int, classes: int):
        self.count = dict(head)
        self.total, self.distinct = total, distinct
        self.words = [w for w, _ in head]
        self.at = {w: i for i, w in enumerate(self.words)}
        self.counts = np.array([n for _, n in head], np.int64)
        c = np.array([n for _, n in head], float) + ADD
        share = np.cumsum(c) / c.sum() if len(c) else c
        group = np.minimum((share * classes - 1e-9).astype(int), classes - 1)
        self.group = np.unique(group, return_inverse=True)[1] if len(c) else group.astype(int)
        self.groups = int(self.group.max()) + 1 if len(c) else 0
        self.start = np.searchsorted(self.group, np.arange(self.groups + 1))
        # shapes with less than a hundredth of the rare words' tokens share a class
        often = mass >= mass.sum() / 100
        self.tail = np.where(often, np.cumsum(often) - 1, often.sum())
        self.mass = np.bincount(self.tail, mass)
        self.prior = np.concatenate([np.bincount(self.group, c, self.groups) if self.groups else np.zeros(0), self.mass])

    def codes_of(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Codes of words' numbers: the head words' places; beyond, k + BUCKETS * shape + a hash bucket."""
        k = len(self.words)
        rare = k + BUCKETS * shapes.astype(np.int64) + words % BUCKETS
        if not k:
            return rare.astype(np.int32)
        keys = np.array(self.words, np.int64)
        order = np.argsort(keys)
        at = order[np.minimum(np.searchsorted(keys[order], words), k - 1)]
        return np.where(keys[at] == words, at, rare).astype(np.int32)

    def inputs_of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the input table: a head word's own, or its hash bucket's."""
        k = len(self.words)
        return np.where(codes < k, codes, k + (codes - k) % BUCKETS)

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        """Output classes: a head word's group, or its shape's."""
        k = len(self.words)
        own = self.group[np.minimum(codes, max(k - 1, 0))] if k else 0
        return np.where(codes < k, own, self.groups + self.tail_of(codes))

    def tail_of(self, codes: np.ndarray) -> np.ndarray:
        """The class of rare words' codes among those of shapes."""
        return self.tail[np.maximum(codes - len(self.words), 0) // BUCKETS]

    @property
    def inputs(self) -> int:
        return len(self.words) + BUCKETS


def initial(v: Vocabulary, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    c = np.array([v.count[w] for w in v.words], float) + ADD
    n = len(v.prior)
    p = {
        "E": r.normal(0, 1.0, (v.inputs, hidden)), "X": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "U": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
        "C": r.normal(0, 0.02, (hidden, n)), "c": np.log(v.prior / v.prior.sum()), "W": r.normal(0, 0.02, (len(c), hidden)), "w": np.log(c),
    }
    p["b"][:hidden] -= 1.0  # remember at first
    return {k: x.astype(np.float32) for k, x in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def chances(weights: np.ndarray, h: np.ndarray, own: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's `own` among outputs that are weights times rows of h; grad: also the slope of its negative, (outputs, rows).

    Outputs lie along the first axis, so that each step over them takes many rows at once. Each row is shifted by its largest value, so that none vanishes beside another.
    """
    z, row = weights @ h.T, np.arange(len(h))
    found, shift = z[own, row], z.max(0)
    z -= shift
    np.exp(z, out=z)
    total = np.ones(len(z), z.dtype) @ z
    found -= np.log(total) + shift
    if grad:
        z *= 1 / total
        z[own, row] -= 1
    return found, z


class Lanes:
    """Documents laid end to end in lanes of about equal length, so that every step has many tokens.

    `y` (steps, lanes) holds the codes, -1 beyond a lane's end; `fresh` marks documents' first tokens, where the
    state starts anew. Lanes are in order of length, longest first; there are no more than the longest document needs.
    """

    def __init__(self, docs: list[np.ndarray], most: int):
        sizes = np.array([len(d) for d in docs])
        n = int(min(max(1, sizes.sum() // sizes.max()), most))
        heap, parts = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            filled, lane = heap[0]
            heapreplace(heap, (filled + len(docs[i]), lane))
            parts[lane].append(i)
        filled = sorted(heap, key=lambda x: (-x[0], x[1]))
        self.sizes = np.array([f for f, _ in filled])
        self.order = [i for _, lane in filled for i in parts[lane]]
        self.y = np.full((n, int(self.sizes[0])), -1, np.int32)
        fresh = np.zeros(self.y.shape, bool)
        for row, (size, lane) in enumerate(filled):
            self.y[row, :size] = np.concatenate([docs[i] for i in parts[lane]])
            fresh[row, np.cumsum([0, *sizes[parts[lane]][:-1]])] = True
        self.real = self.y >= 0
        self.firsts = np.concatenate([[0], np.cumsum(sizes[self.order])[:-1]])
        self.y, self.fresh = np.ascontiguousarray(self.y.T), np.ascontiguousarray(fresh.T)

    def windows(self, span: int, end: int):
        """(inputs, targets, fresh) of each window, of the lanes that reach it."""
        last = np.full(self.y.shape[1], end, np.int32)
        for t in range(0, len(self.y), span):
            n = int((self.sizes > t).sum())
            y = self.y[t : t + span, :n]
            yield np.maximum(np.concatenate([last[None, :n], y[:-1]]), 0), y, self.fresh[t : t + span, :n]
            last = y[-1]

    def per_document(self, found: np.ndarray) -> np.ndarray:
        """Sums of (steps, lanes) values over each document, in the order the documents came in."""
        out = np.zeros(len(self.order))
        out[self.order] = np.add.reduceat(np.ascontiguousarray(found.T)[self.real], self.firsts)
        return out


def portions(docs: list[np.ndarray], most: int):
    """Runs of documents of `most` tokens or little more, a longer document alone."""
    first, n = 0, 0
    for i, d in enumerate(docs):
        if n and n + len(d) > most:
            yield docs[first:i]
            first, n = i, 0
        n += len(d)
    if n:
        yield docs[first:]


def adagrad(p: np.ndarray, square: np.ndarray, grad: np.ndarray, scale: float, rate: float) -> None:
    """A step in place; grad is used up."""
    grad *= scale
    np.clip(grad, -5, 5, out=grad)
    square += grad * grad
    grad /= np.sqrt(square)
    grad *= rate
    p -= grad


class Network:
    def __init__(self, v: Vocabulary, params: dict[str, np.ndarray]):
        one_blas_thread()
        self.v, self.p = v, params
        self.hidden = params["U"].shape[0]
        self.square = {k: np.full_like(x, 0.1) for k, x in params.items()}
        self.by_input: np.ndarray | None = None  # gates of each input, while weights stay as they are

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """Hidden states after each step of input rows x (steps, lanes); keep: also what back-propagation needs, each (steps, lanes, values)."""
        p, n = self.p, self.hidden
        out = np.empty((len(x), x.shape[1], n), p["U"].dtype)
        before, zrs, cs, us = (np.empty((*x.shape, m * n), out.dtype) for m in (1, 2, 1, 3)) if keep else [None] * 4
        gates = self.gates(x)
        old, some = (~fresh)[..., None].astype(out.dtype), fresh.any(1)
        for t in range(len(x)):
            if some[t]:
                h = h * old[t]
            u = np.matmul(h, p["U"], out=us[t] if keep else None)
            zr = np.add(gates[t, :, : 2 * n], u[:, : 2 * n], out=zrs[t] if keep else None)
            sigmoid(zr)
            c = np.multiply(zr[:, n:], u[:, 2 * n :], out=cs[t] if keep else None)
            c += gates[t, :, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                before[t] = h
            new = np.subtract(c, h, out=out[t])
            new *= zr[:, :n]
            new += h
            h = new
        return out, (before, zrs, cs, us)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What inputs add to the gates: a row of a table for each input, made before where there are fewer inputs than tokens."""
        p = self.p
        if self.by_input is not None:
            return np.take(self.by_input, x, axis=0)
        if x.size > len(p["E"]):
            return np.take(p["E"] @ p["X"] + p["b"], x, axis=0)
        return np.take(p["E"], x, axis=0) @ p["X"] + p["b"]

    def log_p(self, h: np.ndarray, y: np.ndarray, grad: bool = False):
        """Log probabilities of target codes y given states h (both flat), tail words' count factor left out; grad: also the gradients."""
        p, v = self.p, self.v
        cls, k = v.classes_of(y), len(v.words)
        out, dh = np.empty(len(y), h.dtype), np.empty_like(h) if grad else None
        h1 = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)  # the last weight is the bias
        weights = np.concatenate([p["C"].T, p["c"][:, None]], 1)
        slope = np.zeros_like(weights)
        for i in range(0, len(y), ROWS):  # tables of few rows stay in the processor's cache
            hs = h1[i : i + ROWS]
            out[i : i + ROWS], z = chances(weights, hs, cls[i : i + ROWS], grad)
            if grad:
                slope += z @ hs
                dh[i : i + ROWS] = (p["C"] @ z).T
        g = {"C": slope[:, :-1].T.copy(), "c": slope[:, -1].copy()} if grad else {}
        at = np.flatnonzero(y < k)
        own = cls[at].astype(np.int16 if v.groups < 1 << 15 else np.int64)  # short numbers sort faster
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        edges = np.searchsorted(own, np.arange(v.groups + 1))
        weights = np.concatenate([p["W"], p["w"][:, None]], 1)
        slope, hs, ys = np.zeros_like(weights), h1[at], y[at]
        inner, dhs = np.zeros(len(at), h.dtype), np.zeros((len(at), self.hidden), h.dtype) if grad else None
        for q in range(v.groups):
            some, a, b = slice(edges[q], edges[q + 1]), v.start[q], v.start[q + 1]
            if some.start == some.stop or b - a == 1:
                continue
            inner[some], z = chances(weights[a:b], hs[some], ys[some] - a, grad)
            if grad:
                slope[a:b] = z @ hs[some]
                dhs[some] = (p["W"][a:b].T @ z).T
        out[at] += inner
        if not grad:
            return out
        dh[at] += dhs
        return out, dh, g | {"W": slope[:, :-1].copy(), "w": slope[:, -1].copy()}

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """One window of codes: log probabilities of its tokens, the last state, and the gradients of their negative sum, by truncated
        back-propagation; those of the input table as (rows, gradients) under "E"."""
        p, n = self.p, self.hidden
        x = self.v.inputs_of(x)
        out, (before, zr, c, u) = self.states(x, fresh, h, True)
        real = y.ravel() >= 0
        log, dh, g = self.log_p(out.reshape(-1, n)[real], y.ravel()[real], True)
        per_step = np.zeros((y.size, n), out.dtype)
        per_step[real] = dh
        per_step = per_step.reshape(out.shape)
        # the slopes of a step's state to its gates and candidate, for all steps at once
        z, r = zr[:, :, :n], zr[:, :, n:]
        to_z = (c - before) * (z - z * z)
        to_c = z * (1 - c * c)
        to_r = to_c * u[:, :, 2 * n :] * (r - r * r)
        to_u = to_c * r
        stay, old, some = 1 - z, (~fresh)[..., None].astype(out.dtype), fresh.any(1)
        du, ds = np.empty((*x.shape, 3 * n), out.dtype), np.empty_like(out)
        back, across = np.zeros_like(out[0]), np.ascontiguousarray(p["U"].T)
        for t in range(len(x) - 1, -1, -1):
            d = np.add(back, per_step[t], out=ds[t])
            np.multiply(d, to_z[t], out=du[t, :, :n])
            np.multiply(d, to_r[t], out=du[t, :, n : 2 * n])
            np.multiply(d, to_u[t], out=du[t, :, 2 * n :])
            back = du[t] @ across
            d = d * stay[t]
            back += d
            if some[t]:
                back *= old[t]
        flat, ids = du.reshape(-1, 3 * n), x.ravel()
        g["U"] = before.reshape(-1, n).T @ flat
        flat[:, 2 * n :] = (ds * to_c).reshape(-1, n)
        g["b"], g["X"] = np.ones(len(flat), flat.dtype) @ flat, np.take(p["E"], ids, axis=0).T @ flat
        order = np.argsort(ids.astype(np.int16) if len(p["E"]) < 1 << 15 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["E"] = ids[order][first], np.add.reduceat(np.take(flat @ p["X"].T, order, axis=0), first, axis=0)
        return log, out[-1], g

    def learn(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """An Adagrad step on one window; returns the last state."""
        log, last, g = self.gradients(x, y, fresh, h)
        scale = 64 / max(1, len(log))
        rows, ge = g.pop("E")
        part, sums = self.p["E"][rows], self.square["E"][rows]
        adagrad(part, sums, ge, scale, rate)
        self.p["E"][rows], self.square["E"][rows] = part, sums
        for k, grad in g.items():
            adagrad(self.p[k], self.square[k], grad, scale, rate)
        return last

    def train(self, docs: list[np.ndarray], end: int, rate: float) -> int:
        """Every document once; returns the number of tokens."""
        for some in portions(docs, PORTION):
            h = None
            for x, y, fresh in Lanes(some, LANES).windows(WINDOW, end):
                h = self.learn(x, y, fresh, np.zeros((x.shape[1], self.hidden), np.float32) if h is None else h[: x.shape[1]], rate)
        return sum(map(len, docs))

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each document, tail words' count factor left out; the state goes on from window to window."""
        out = [np.zeros(0)]
        self.by_input = self.p["E"] @ self.p["X"] + self.p["b"]
        for some in portions(docs, PORTION):
            lanes, h, t = Lanes(some, LANES), None, 0
            got = np.zeros(lanes.y.shape)
            for x, y, fresh in lanes.windows(WINDOW, end):
                n = x.shape[1]
                states, _ = self.states(self.v.inputs_of(x), fresh, np.zeros((n, self.hidden), np.float32) if h is None else h[:n], False)
                real = y.ravel() >= 0
                part = np.zeros(y.size)
                part[real] = self.log_p(states.reshape(-1, self.hidden)[real], y.ravel()[real])
                got[t : t + len(y), :n] = part.reshape(y.shape)
                h, t = states[-1], t + len(y)
            out.append(lanes.per_document(got))
        self.by_input = None
        return np.concatenate(out)


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def unpacked(x: pa.Scalar) -> np.ndarray:
    """Codes held in a binary value."""
    return np.frombuffer(x.as_buffer(), np.int32)


def averaged(coded: DataFrame, v: Vocabulary, start: dict[str, np.ndarray], rate: float, block: int = 8192) -> dict[str, np.ndarray]:
    """Train on each task's documents, a column of codes, from the same start; the mean of the results, weighted by tokens."""

    def train(batches):
        net, n = Network(v, {k: x.copy() for k, x in start.items()}), 0
        for batch in batches:
            n += net.train([x for x in map(unpacked, batch.column(0))], v.at[END], rate) if batch.num_rows else 0
        if n:
            flat = pack(net.p)
            parts = [flat[i : i + block] for i in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(n)] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "n", "x"])

    def mean(batches):
        block, n, total = None, 0.0, None
        for batch in batches:
            for b, m, x in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if b != block and block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["block", "n", "x"])
                if b != block:
                    block, n, total = b, 0.0, 0.0
                total, n = total + m * np.frombuffer(x, np.float32).astype(np.float64), n + m
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["block", "n", "x"])

    kind = "block int, n double, x binary"
    sent = coded.mapInArrow(train, kind)
    found = sent.repartition("block").sortWithinPartitions("block").mapInArrow(mean, kind).orderBy("block").collect()
    return unpack(np.concatenate([np.frombuffer(r["x"], np.float32) for r in found]), start) if found else start


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out_of: int = 10, head: int = 2048, classes: int = 40, hidden: int = 16, rates: tuple[float, ...] = (0.1, 0.07, 0.05), chunk_bytes: int = 16_000_000) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    out = (in_bucket(F.col(f"`{key}`"), held_out_of) == 0).alias("held_out")
    picked = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("key"), out, F.col(f"`{text}`").alias("text"))
    stamped = store(chunked(picked, chunk_bytes), "texts")
    known_words = store(totalled(chunk_words(stamped)), "words")
    counts = known_words.where("first").select("word", "c", "shape")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head, classes = vocabulary_size(total, head, classes)
    top = [(r["word"], r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(head).collect()]
    if END not in dict(top):
        top.append((END, next((r["c"] for r in counts.where(F.col("word") == F.lit(END)).collect()), 0)))
    top.sort(key=lambda x: (-x[1], x[0]))
    heads = np.sort(np.array([w for w, _ in top], np.int64))

    def masses(batches):
        seen = np.zeros(SHAPES)
        for batch in batches:
            words, c, shapes = (batch.column(k).to_numpy() for k in range(3))
            rare = heads[np.minimum(np.searchsorted(heads, words), len(heads) - 1)] != words
            seen += np.bincount(shapes[rare], c[rare] + ADD, SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(seen)], ["k", "m"])

    mass = np.full(SHAPES, ADD)
    for k, m in counts.mapInArrow(masses, "k int, m double").groupBy("k").agg(F.sum("m")).collect():
        mass[k] += m
    v = Vocabulary(top, mass, total, distinct, classes)
    base = np.log10(total + ADD * (distinct + 1)) if total or distinct else np.log10(ADD)
    log_mass = np.log10(v.mass)

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's documents as codes, with what the counts alone say of them."""
        k = len(v.words)
        numbers, shapes, ends = hashed(left.column("text").combine_chunks())
        words, first, at = distinct_of(numbers)
        listed, c_of = (right.column(x).combine_chunks().to_numpy() for x in ("word", "c"))
        order = np.argsort(listed)
        place = order[np.minimum(np.searchsorted(listed[order], words), max(len(listed) - 1, 0))] if len(listed) else np.zeros(len(words), np.int64)
        c = np.where(listed[place] == words, c_of[place], 0) if len(listed) else np.zeros(len(words), np.int64)
        code = v.codes_of(words, shapes[first])
        far = code >= k
        c = np.where(far, c, np.append(v.counts, 0)[np.minimum(code, k)])
        log_c = np.log10(c + ADD)
        tail = np.where(far, log_c - log_mass[v.tail_of(code)], 0.0)
        ends = np.append(0, ends)
        known, log_sum, tail_sum = (np.add.reduceat(x[at], ends[:-1]) for x in (np.where(c > 0, 1, 0), log_c, tail))
        n = np.diff(ends)
        flat = code[at].tobytes()
        return pa.table({
            "key": left.column("key"), "held_out": left.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "base_score": pa.array(log_sum - n * base, pa.float64()), "tail": pa.array(tail_sum, pa.float64()),
            "codes": pa.array([flat[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    # partitions by chunks, not by a setting: a task has one chunk or a few, or, beyond MOST_PARTS chunks, one after the other
    n = min(MOST_PARTS, max(1, stamped.agg(F.count_distinct("chunk")).first()[0]))
    texts, rights = stamped.repartition(n, "chunk"), known_words.select("chunk", "word", "c").repartition(n, "chunk")
    kind = stamped.schema["key"].dataType.simpleString()
    coded = texts.groupBy("chunk").cogroup(rights.groupBy("chunk")).applyInArrow(encode, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, tail double, codes binary")
    coded = store(coded, "codes")
    drop_stored(spark, known_words)
    drop_stored(spark, stamped)
    params = initial(v, hidden)
    deal = F.pmod(F.xxhash64("key", "codes"), F.lit(12))
    for rate, low, high in zip(rates, (0, 1, 4), (1, 4, 12), strict=True):
        # as many tasks as the round's share of the chunks: a batch takes as many steps as its longest document has tokens, however few others it has
        dealt = coded.where(~F.col("held_out") & (deal >= low) & (deal < high)).select("codes").coalesce(max(1, n * (high - low) // 12))
        params = averaged(dealt, v, params, rate)

    def score(batches):
        net = Network(v, params)
        for batch in batches:
            log = net.score([x for x in map(unpacked, batch.column("codes"))], v.at[END]) / np.log(10) if batch.num_rows else np.zeros(0)
            kept = [batch.column(c) for c in ("key", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(log + batch.column("tail").to_numpy())], ["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = coded.mapInArrow(score, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
