"""The divergence audit against a dense plain version, with nulls, copies, groups without terms and clashing columns."""

import collections
import random
import re

from pyspark.sql import functions as F

from trackmill.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, h string, term int, part string, copies string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in here for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        v = len(kept)
        counts = {s: collections.Counter(t for d in here if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in here}}
        every = sum(counts.values(), collections.Counter())

        def share(c, t, v=v):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        for s, c in counts.items():
            pairs, terms = [], []
            for other, o in counts.items():
                if other != s:
                    pairs.append((-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), other.encode(), other))
            for t in kept:
                p, q = share(c, t), share(every, t)
                if c[t] and p > q:
                    terms.append((-((p - q) ** 2 // q), t.encode(), t))
            out += [(lang, s, "pair", x[2], -x[0], k) for k, x in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x[2], -x[0], k) for k, x in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "h", i, "p", "c") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def corpus():
    rng = random.Random(1)
    names = ["alpha", "Beta", "GAMMA", "delta", "épsilon", "Épsilon", "zeta_eta", "日本", "x1y", "one-two", "ﬀ", "İI", "ß"]
    rows = []
    for _ in range(90):
        text = " ".join(rng.choice(names) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "", "Z"])))
    rows += [(rows[0][0], rows[0][1], rows[0][2])] * 7 + [(rows[1][0], "en", s) for s in "abcabc"]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("12 34", "fr", "c"), ("once", "fr", "a"), ("alone here", "it", "only"), ("beta " * 5000, "en", "long"), (None, None, None)]
    rows += [("same same", "xx", s) for s in "pqrst"]
    return rows


def test_audit_equals_the_dense_sums(spark):
    rows = corpus()
    assert got(source_divergence.audit(frame(spark, rows))) == plain(rows)


def test_audit_with_other_limits_and_few_ranks(spark):
    rows = corpus()
    assert got(source_divergence.audit(frame(spark, rows), least_docs=1, ranks=3)) == plain(rows, 1, 3)


def test_audit_of_large_counts_is_exact(spark):
    """Counts that overflow a long when they are scaled by 10^9."""
    counts = spark.createDataFrame(
        [("en", s, t, c, 5) for s, t, c in (("a", "x", 3 * 10**12), ("a", "y", 7), ("b", "x", 1), ("b", "y", 10**13), ("c", "z", 1))] + [("en", s, None, 0, 0) for s in "abcd"],
        "lang string, source string, term string, c bigint, docs bigint",
    )
    counts = source_divergence.kept_terms(counts, 3)
    kept = counts.where("term is not null")
    by_count = source_divergence.histogram(kept)
    groups = source_divergence.totals(counts, by_count)
    out = {(r["source"], r["item"]): r["value"] for r in source_divergence.pair_part(source_divergence.shares(kept, groups), by_count, groups).collect()}
    c = {"a": {"x": 3 * 10**12, "y": 7}, "b": {"x": 1, "y": 10**13}, "c": {"z": 1}, "d": {}}

    def p(s, t):
        return 1 + 10**9 * (c[s].get(t, 0) + 1) // (sum(c[s].values()) + 3)

    for s in "abcd":
        for o in "abcd":
            if s != o:
                assert out[s, o] == sum((p(s, t) - p(o, t)) ** 2 // p(o, t) for t in "xyz")


def test_audit_of_nothing(spark):
    empty = frame(spark, corpus()).limit(0)
    assert got(source_divergence.audit(empty)) == []
    assert got(source_divergence.audit(frame(spark, [(None, None, None)]))) == []


def test_texts_are_tokenised_once_a_language(spark):
    rows = [("a text", "en", s) for s in "aabbb"] + [("a text", "de", "a"), ("b", "en", "a")]
    texts = source_divergence.collapsed(frame(spark, rows))
    found = {(r["lang"], r["text"]): sorted((c["source"], c["n"]) for c in r["copies"]) for r in texts.collect()}
    assert found == {("en", "a text"): [("a", 2), ("b", 3)], ("de", "a text"): [("a", 1)], ("en", "b"): [("a", 1)]}
    assert texts.agg(F.count("*")).first()[0] == 3
