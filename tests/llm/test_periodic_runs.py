"""Runs and collapsed texts against their definition."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic(rng):
    base = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
    noise = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
    return (base * rng.randint(1, 9))[: rng.randint(1, 120)] + noise


def sequences():
    rng = random.Random(8)
    out = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(150)]
    out += [sum((periodic(rng) for _ in range(rng.randint(1, 4))), []) for _ in range(150)]
    for _ in range(30):  # periods of periods
        x = sum((periodic(rng)[:9] for _ in range(2)), [])
        out.append((x * 5)[: rng.randint(1, 70)] * rng.randint(1, 5))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return [*out, list(fib[-1]), ["a"] * 1000, list("ab") * 333, [], ["x"], list("aaaaaa"), list("aaaaa"), list("abababab")]


def test_runs_equal_the_definition():
    texts = sequences()
    for together in (1, 7, len(texts)):
        for k in range(0, len(texts), together):
            part = texts[k : k + together]
            got = periodic_runs.runs_of([[x.encode() for x in t] for t in part], 6, 4)
            for t, rows in zip(part, got, strict=True):
                runs = plain_runs(t)
                assert [tuple(map(int, r)) for r in rows] == runs
                assert periodic_runs.collapsed([x.encode() for x in t], rows).decode() == plain_collapsed(t, runs)
            if together == 1 and k > 60:
                break


def test_range_successor_equals_sorting():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    made = periodic_runs.Successors(values, 9)
    low = rng.integers(0, 299, 500)
    high = low + 1 + rng.integers(0, 300 - low)
    x = rng.integers(0, 301, 500)
    k = rng.integers(0, high - low)
    assert list(made.smaller(low, high, x)) == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, x, strict=True)]
    assert list(made.kth(low, high, k)) == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


def planted(key, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if key is None else str(key)).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def rows():
    rng = random.Random(9)
    texts = [rng.choice([" ", "\n", "\t "]).join(t) for t in sequences()[::4]]
    texts += [None, "", " \n\x0b\x0c ", "word " * 30_000, "a b a b " * 8, "日本 é " * 9, " ".join(f"w{rng.randint(0, 40)}" for _ in range(3000)), "x" * 50_000]
    out = [(i if i % 11 else None, t, "old", 1, "s") for i, t in enumerate(texts * 2)]
    return [*out, out[3], out[3]]


@pytest.mark.parametrize("parts", [1, 5])
def test_report_equals_the_definition(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, periodic string, n_words int, runs string").repartition(parts)
    want = collections.Counter()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    known = {}
    for key, text, *_ in data:
        w = planted(key, text)
        if tuple(w) not in known:
            known[tuple(w)] = [(0, len(w), 1)] if len(w) > 5000 and len(set(w)) == 1 else plain_runs(w) if len(w) < 5000 else None
        runs = known[tuple(w)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[key, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(w, runs))] += 1
    got = periodic_runs.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want


def test_rows_and_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b", "old", 2), (2, None, "old", 3)], "doc_id bigint, text string, periodic string, n_words int")
    got = {r["doc_id"]: r for r in periodic_runs.find(df).collect()}
    assert got[1]["periodic"].asDict(True) == {"n_words": 8, "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b"}
    assert got[2]["periodic"].asDict(True) == {"n_words": 0, "runs": [], "collapsed": ""}
    assert (got[1]["n_words"], got[1]["text"]) == (2, "a b a b a b a b")
    assert periodic_runs.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find(df, least_times=3)
    assert periodic_runs.find(df, least_times=5).select(F.size("periodic.runs")).distinct().collect() == [(0,)]
