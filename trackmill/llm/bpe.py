"""Byte-level BPE: exact backtracking encoder and offset-table decoder.

The encoder never merges. At each byte it takes the longest token that matches (Aho-Corasick over the
vocabulary); a token may follow another only if the pair is compatible, that is, if merging the two
tokens' bytes together would give just these two; when the pair is not, it backs off to the next
shorter token that is a prefix, and when none is left, drops the last token and tries again. A bit
per byte keeps dead ends from being tried twice, so time is linear in the input. The result equals
that of applying the merges in order of rank.

Decoding joins byte ranges of one blob of all tokens by a table of offsets, in numpy.

Texts are split before encoding as the vocabulary's pre-tokenizer does, with the special token
cut out first. Defined results: null is the empty text, which has no ids; unpaired surrogates are
refused by the reader of the table, not here; results depend on the text alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokenizer of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in either of a worker's two dictionaries, and pairs of tokens; beyond, the words of the older one go, or all pairs.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 itself, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = raw(t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes])])
        self.ids = {raw(t): i for t, i in vocab.items()}
        # how a token comes about: the pair of its merge, and the rank of that merge
        self.split: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.rank = [-1] * size
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = vocab[a], vocab[b]
            made = vocab[a + b]
            self.pairs[left, right] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], self.split[made] = r, (left, right)
        # Aho-Corasick over the tokens; the longest that starts at a place comes from its trie
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t.decode("latin-1"), i)
        self.trie.make_automaton()
        # the next shorter token that is a prefix
        self.prefix = [-1] * size
        for t, i in self.ids.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := self.ids.get(t[:n])) is not None:
                    self.prefix[i] = j
                    break
        self.size = [len(x) for x in self.bytes]
        self.table: dict[int, bool] = {}
        self.split_text = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens together ends in just these two."""
        key = left << 32 | right
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # undo the merges of both sides, latest first, and see whether a merge across the border came before
        limit = 1 << 60
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made[0] < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit = self.rank[a]
                a = self.split[a][1]
            elif self.rank[b] >= 0:
                limit = self.rank[b] + 1
                b = self.split[b][0]
            else:
                return True

    def longest(self, word: str) -> list[int]:
        """For each byte the longest token that starts there: matches come by their ends, so a start's last is its longest."""
        best, size = [-1] * len(word), self.size
        for end, token in self.trie.iter(word):
            best[end + 1 - size[token]] = token
        return best

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None and self.rank[whole] < 0:
            return [whole]
        best, size, prefix, table = self.longest(word.decode("latin-1")), self.size, self.prefix, self.table
        end, open_ = len(word), bytearray(b"\1") * (len(word) + 1)
        out: list[int] = []
        at, token, last = 0, best[0], -1
        while True:
            stop = at + size[token]
            if open_[stop]:
                if last < 0:
                    fits = True
                elif (fits := table.get(last << 32 | token)) is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if stop == end:
                        return out
                    at, token, last = stop, best[stop], token
                    continue
            token = prefix[token]
            while token < 0:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = prefix[token]
            last = out[-1] if out else -1

    def word_ids(self, word: str) -> str:
        """The ids of a word of the pre-tokenizer, as decimals joined by commas."""
        known = self.older.get(word)
        if known is None:
            if len(self.table) >= CACHE:
                self.table.clear()
            known = ",".join(map(str, self.encode_word(word.encode("utf-8"))))
        if len(word) < 200:
            if len(self.words) >= CACHE:
                self.older, self.words = self.words, {}
            self.words[word] = known
        return known

    def encode_part(self, part: str) -> str:
        """The same of text without special tokens."""
        words = self.split_text.findall(part)
        found = list(map(self.words.get, words))
        for k, known in enumerate(found):
            if known is None:
                found[k] = self.words.get(words[k]) or self.word_ids(words[k])
        return ",".join(found)

    def encode_joined(self, text: str) -> str:
        """All ids as decimals joined by commas."""
        parts = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
        return ",".join([str(self.special[x]) if x in self.special else self.encode_part(x) for x in parts if x])

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, from the offset table."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        if not total:
            return b""
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.blob[shift + np.arange(total)].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.asarray(list(ids), np.int64)).decode("utf-8", "replace")


def numbers(joined: str) -> np.ndarray:
    """Decimals joined by commas as an array."""
    return np.fromstring(joined, np.int64, sep=",") if joined else np.zeros(0, np.int64)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder a worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_column(df: DataFrame, text: str, path: str, result: str = "ids", decoded: str | None = None, rows_at_once: int = 128) -> DataFrame:
    """All rows and columns of df with the token ids of a text column, as array<int>.

    decoded: also a column with the text decoded from these ids. Results leave in small batches, so memory holds few rows' ids.
    """

    def rows(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids = [numbers(bpe.encode_joined(x.as_py() or "")) for x in part.column(text)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
                made = {result: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                if decoded:
                    made[decoded] = pa.array([bpe.decode_bytes(x).decode("utf-8", "replace") for x in ids], pa.string())
                keep = [c for c in part.schema.names if c not in made]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made.values()], [*keep, *made])

    extra = [f"`{result}` array<int>", *([f"`{decoded}` string"] if decoded else [])]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(result, *([decoded] if decoded else [])).schema], *extra])
    return df.mapInArrow(rows, fields)


def decode_column(df: DataFrame, ids: str, path: str, result: str = "decoded", rows_at_once: int = 128) -> DataFrame:
    """All rows and columns of df with the text of a column of token ids; null ids give null."""

    def rows(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = [bpe.decode_bytes(x.values.to_numpy().astype(np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in part.column(ids)]
                keep = [c for c in part.schema.names if c != result]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, result])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(result).schema], f"`{result}` string"])
    return df.mapInArrow(rows, fields)


def digests(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: its key, number of ids, sha256 of the joined ids, sha256 of the text decoded from them."""

    def rows(batches):
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1).to_pylist():
                joined = bpe.encode_joined(x or "")
                ids = numbers(joined)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = df.select(key, text)
    return picked.mapInArrow(rows, f"`{key}` {picked.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
