"""Each text operator against a plain version, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.llm import bpe, jaccard_join, kneser_ney, line_dedup, media, mixing, quality_rules, recurrent_lm, toxicity, url_filters
from trackmill.llm.registry import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, score int, uid string, chunk int, key string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "stone", "river", "house", "walks", "green", "cloud", "seven"]) + rng.choice(["", "", "ly", "er", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = "\n".join(prose(rng, 30) for _ in range(3))
    some = [prose(rng, rng.randint(20, 80)) + "\n" + prose(rng, 60) for _ in range(30)]
    some += [passage + "\n" + prose(rng, 20), prose(rng, 12) + "\n" + passage, passage, passage]
    some += [None, "", " \n\t ", "one two", "one two", "word " * 4000, "A!! B!! " * 60, "x" * 5000, "é ü ñ 日本 " * 30, some[0], some[0] + " tail"]
    return some


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if t is not None else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "old", i, "u", 1, "k") for i, t in enumerate(texts)]
    rows.append(rows[2])
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    return collections.Counter((r["doc_id"], tuple(r)) for r in df.collect())


def test_quality_counts_match_plain_ones(docs, texts):
    got = {r["doc_id"]: r["quality"] for r in quality_rules.judge(docs).collect() if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        if t is None:
            continue
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (q["n_dup_lines"], q["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert q["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (q["kept"] and q["base_failed"])


def test_quality_verdicts_follow_the_fitted_posterior(docs):
    rows = [r["quality"] for r in quality_rules.judge(docs).collect()]
    assert len(rows) == docs.count()
    counts = collections.Counter(r["votes"] for r in rows)
    share, table = quality_rules.fit(sorted(counts.items()))
    for r in rows:
        p = quality_rules.posterior(share, table, r["votes"])[0]
        assert r["posterior"] == pytest.approx(p, rel=1e-9)
        assert r["kept"] == (p >= 0.5 and not r["base_failed"])
    assert quality_rules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bad", [0.1, 0.02, 0.0])
def test_quality_fit_recovers_planted_rates(bad):
    rng = random.Random(4)
    alarms = (0.02, 0.01, 0.03, 0.005, 0.01, 0.02, 0.04, 0.01, 0.02)
    sees = (0.5, 0.6, 0.4, 0.7, 0.5, 0.6, 0.3, 0.5, 0.4)
    counts = collections.Counter()
    for _ in range(30_000):
        rates = sees if rng.random() < bad else alarms
        counts["".join("b" if rng.random() < r else "g" for r in rates)] += 1
    share, table = quality_rules.fit(sorted(counts.items()))
    assert share[0] == pytest.approx(1 - bad, abs=0.01)
    for rule, want in zip(table, alarms, strict=True):
        assert rule[0]["b"] == pytest.approx(want, abs=0.006)


def test_quality_fit_tells_kinds_of_junk_apart():
    counts = {"ggggggggg": 9000, "ggbbggggg": 400, "gggggbgbg": 300, "gggggbgbb": 100, "agggggggg": 200}
    share, table = quality_rules.fit(sorted(counts.items()))
    kept = {v: quality_rules.posterior(share, table, v)[0] >= 0.5 for v in counts}
    assert kept == {"ggggggggg": True, "agggggggg": True, "ggbbggggg": False, "gggggbgbg": False, "gggggbgbb": False}


def plain_dedup(rows, least=50):
    """By definition: lines in any run of enough words that starts earlier somewhere else."""
    seqs = []
    for i, t in rows:
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        seqs.append((i, lines))
    places = [(a, k) for a, (_, ls) in enumerate(seqs) for k in range(len(ls))]
    gone = collections.defaultdict(set)
    for n, (a, k) in enumerate(places):
        ls = [x for _, x in seqs[a][1]]
        for b, m in places[:n]:
            other, size = [x for _, x in seqs[b][1]], 0
            while k + size < len(ls) and m + size < len(other) and ls[k + size] == other[m + size]:
                size += 1
            if sum(len(WORD.findall(x)) for x in ls[k : k + size]) >= least:
                gone[a] |= {seqs[a][1][j][0] for j in range(k, k + size)}
    return {rows[a][0]: sorted(x) for a, x in gone.items()}


def test_line_ranks_do_not_depend_on_reused_exchanges(spark):
    rng = random.Random(15)
    rows = [(i, "\n".join(f"{rng.randint(0, 400)} " + "w " * rng.choice([20, 60]) for _ in range(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            found.append({(r["doc_id"], *r["dedup"]["deleted"]) for r in line_dedup.dedup(df).collect()})
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
    assert found[0] == found[1]


def test_line_dedup_matches_definition(spark, texts):
    rng = random.Random(5)
    pool = [prose(rng, rng.choice([3, 10, 26, 55])) for _ in range(6)]
    more = ["\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(1, 7))) for _ in range(25)]
    rows = list(enumerate([t for t in texts if t is not None and len(t) < 4000] + more))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    want = plain_dedup(rows)
    assert {i: list(r["dedup"]["deleted"]) for i, r in got.items() if r["dedup"]["n_deleted"]} == want
    for i, t in rows:
        if i not in want:
            assert got[i]["text"] == t
        else:
            rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
            assert got[i]["text"] == (rest if WORD.search(rest) else "")


def test_line_dedup_edges(docs, spark):
    out = line_dedup.dedup(docs)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "dedup"}
    assert [r["text"] for r in out.where("doc_id is null").collect()] == [None]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_mixing_windows_and_deviation(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "a").when(F.col("id") < 2500, "b").otherwise("c").alias("source"))
    shares = {"a": 3, "b": 2, "c": 1}
    rows = mixing.interleave(df, shares=shares, block=10).select("doc_id", "mix.*").collect()
    assert len({r["doc_id"] for r in rows}) == 3000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    blocks = collections.defaultdict(set)
    for r in rows:
        blocks[r["slot"]].add((r["stream"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values())
    done = collections.Counter()
    for n, t in enumerate(sorted(blocks), 1):
        done[next(iter(blocks[t]))[0]] += 1
        if n <= 6 * 50:  # until c runs out
            assert all(abs(done[s] - n * w / 6) < 1 for s, w in shares.items())


def test_mixing_schedules_every_source_by_its_own_share(spark):
    shares = {f"s{k}": 1 + k % 3 for k in range(1100)} | {"big": 500}
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 1100)).alias("source"))
    rows = mixing.interleave(df, shares=shares, block=1).select("source", "doc_id", "mix.*").collect()
    assert len({r["doc_id"] for r in rows}) == len({r["slot"] for r in rows}) == 6000
    assert all(r["stream"] == r["source"] and r["release"] <= r["slot"] < r["deadline"] for r in rows)
    total, first = sum(shares.values()), min(r["slot"] for r in rows if r["phase"] == 1)
    done = collections.Counter()
    for n, r in enumerate(sorted((r for r in rows if r["slot"] < min(first, total)), key=lambda r: r["slot"]), 1):
        done[r["source"]] += 1
        if r["slot"] == n - 1:  # until a source runs out
            assert all(abs(done[s] - n * shares[s] / total) < 1 for s in ("big", "s1", "s2", r["source"]))


def plain_schedule(shares):
    """Slot by slot: of the jobs released by now the one that is due first; ties to the smaller share, then the first."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // a), a, i) for i, a in enumerate(shares) if done[i] < a and done[i] * total // a <= t]
        i = min(ready)[2]
        done[i] += 1
        out.append(i)
    return out


def test_mixing_period_equals_a_plain_schedule(spark):
    rng = random.Random(2)
    for shares in [[1], [3, 2, 1], [5, 5, 5], [1, 1, 97], *[[rng.randint(1, 20) for _ in range(rng.randint(2, 9))] for _ in range(5)]]:
        want = plain_schedule(shares)
        assert mixing.one_period(shares) == want
        assert spark.range(1).select(mixing.period(F.array(*[F.lit(a).cast("long") for a in shares])).alias("o")).first()["o"] == want


def test_mixing_odd_sources_and_many_of_them(spark):
    rows = [(None, None), (None, "\x00"), (None, ""), (None, "="), (None, None), (3, "a"), (3, "a")]
    out = mixing.interleave(spark.createDataFrame(rows, "doc_id bigint, source string")).select("source", "mix.stream").collect()
    assert len(out) == 7 and all(r["source"] == r["stream"] for r in out)
    sizes = [(k, j) for k in range(300) for j in range(1 + k // 3)]  # 300 sources of a hundred sizes
    df = spark.createDataFrame([(i, f"s{k}") for i, (k, _) in enumerate(sizes)], "doc_id bigint, source string")
    got = mixing.interleave(df, block=2).select("source", "mix.*").collect()
    assert len(got) == len(sizes) and all(r["stream"] == r["source"] and r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mixing_is_the_same_on_either_way(docs):
    pick = lambda df: collections.Counter((r["doc_id"], r["text"], *r["mix"]) for r in df.collect())
    assert pick(mixing.interleave(docs, block=4)) == pick(mixing.interleave(docs, block=4, most_streams=1))


@pytest.mark.parametrize("most", [32, 1])
def test_mixing_sources_without_a_share_come_last(spark, most):
    rows = [(i, f"s{i % 4}") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    out = mixing.interleave(df, shares={"s0": 0, "s1": 3, "s2": 1, "s3": 0}, block=5, most_streams=most).select("source", "doc_id", "mix.*").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(203))
    order = sorted((r["slot"], r["source"]) for r in out)
    first = [s for _, s in order]
    assert set(first[: sum(s in ("s1", "s2") for s in first)]) == {"s1", "s2"}
    assert {r["source"]: r["stream"] for r in out} == {f"s{k}": f"s{k}" for k in range(4)}
    assert len(mixing.interleave(df, shares=dict.fromkeys(("s0", "s1", "s2", "s3"), 0), most_streams=most).collect()) == 203
    with pytest.raises(ValueError):
        mixing.interleave(df, shares={"s0": -1})


def test_mixing_edges(docs):
    out = mixing.interleave(docs)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "mix"}
    assert out.where("mix.slot is null").count() == 0
    assert mixing.interleave(docs.limit(0)).count() == 0


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    rng = random.Random(1)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "  a  b ", "\n\n\t x", "don't we'll", "日本語 123456", "a\u3000 b", "zzzz" * 300]
    odd += ["".join(rng.choice("ab éñ\n\t1,.!<|>ß😀") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for t in [x for x in texts if x] + odd:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_encodes_each_word_once(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE", 40)
    lib, own = Tokenizer.from_file(VOCABULARY), bpe.Bpe(VOCABULARY)
    rng = random.Random(3)
    blanks = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\u3000", " \u3000", "\x1c ", "\x85", "\t", "   ", " <|endoftext|> "]
    for _ in range(300):  # the same words between all kinds of blanks, at borders too
        t = "".join(rng.choice(["", "the", "The", "wörd", "ab.", "x1", "don't"]) + rng.choice(blanks) for _ in range(rng.randint(1, 12)))
        for x in (t, t.strip(), t + "end"):
            assert own.encode(x) == lib.encode(x, add_special_tokens=False).ids, x
    monkeypatch.setattr(bpe, "CACHE", 1000)
    made, encode = [], own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda w: (made.append(w), encode(w))[1])
    own.encode("glorp\nglorp. (glorp) glorp, glorp; glorp.\nglorp")
    assert made.count(b" glorp") <= 1 and made.count(b"glorp") <= 1 and max(collections.Counter(made).values()) == 1


def test_bpe_columns(docs):
    out = bpe.decode_column(bpe.encode_column(docs, "text", VOCABULARY), "ids", VOCABULARY)
    for r in out.collect():
        assert r["decoded"] == (r["text"] or "")
    assert bpe.digests(docs, "doc_id", "text", VOCABULARY).count() == docs.count()


def test_media_round_trip(texts):
    for t in [x for x in texts if x] + ["", "y" * 576, "y" * 577]:
        raw = media.padded(t.encode())
        data = media.pack(raw)
        (track,) = media.probe(data)
        assert media.read_back(data, track) == raw and track.codec == "raw "
        assert track.duration == len(raw) and len(track.samples()) == len(raw) // 576
        keys = track.key_frames()
        assert [data[a:b] for a, b in keys] == [raw[k : k + 576] for k in range(0, len(raw), 576 * 8)]


def test_media_strange_bytes(spark):
    good = media.pack(media.padded(b"abc"))
    for x in (None, b"", b"\0" * 7, b"no container at all", good[:100], good[:-1], b"\0\0\0\0moov" + good, b"\xff" * 50):
        media.probe(x)
    wide = media.box(b"free", b"1") + good.replace(b"isom", b"isom")
    assert len(media.probe(wide)) == 1
    df = spark.createDataFrame([(1, good), (2, None)], "tracks int, m binary")
    assert sorted(len(r["tracks"]) for r in media.probe_column(df, "m").collect()) == [0, 1]


def test_media_hostile_tables():
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.probe(deep) == []
    stbl = media.box(
        b"stbl", media.full(b"stsz", 0, (100).to_bytes(4, "big"), b"\xff" * 4), media.full(b"stsc", 0, (1).to_bytes(4, "big"), (1).to_bytes(4, "big"), b"\xff" * 4, bytes(4)),
        media.full(b"stco", 0, (1).to_bytes(4, "big"), (8).to_bytes(4, "big")),
    )
    (track,) = media.probe(media.box(b"moov", media.box(b"trak", stbl)))
    assert len(track.samples()) <= 1


def test_media_fragments_and_compact_sizes():
    num = lambda *xs: b"".join((x & 0xFFFFFFFF).to_bytes(4, "big") for x in xs)
    flags = lambda kind, f, *parts: media.box(kind, f.to_bytes(4, "big"), *parts)
    trak = media.box(b"trak", media.full(b"tkhd", 0, num(0, 0, 7, 0, 0)), media.box(b"mdia", media.full(b"mdhd", 0, num(0, 0, 1000, 0))))
    head = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", 0, num(7, 1, 40, 5, 0x10000))))

    def moof(offset):
        return media.box(b"moof", media.box(b"traf", flags(b"tfhd", 0x20000, num(7)), flags(b"trun", 0x1 | 0x4 | 0x200, num(3, offset, 0), num(4, 6, 2)), flags(b"trun", 0, num(2))))

    size = len(moof(0))
    data = head + moof(size + 8) + media.box(b"mdat", b"aaaabbbbbbccdddddeeeee")
    (track,) = media.probe(data)
    assert [data[a:b] for a, b in track.samples()] == [b"aaaa", b"bbbbbb", b"cc", b"ddddd", b"eeeee"]
    assert [data[a:b] for a, b in track.key_frames()] == [b"aaaa"]
    assert (track.number, track.duration, track.timescale) == (7, 200, 1000)
    for bits, raw, want in ((4, b"\x12\x30", [1, 2, 3]), (8, b"\x01\x02\x03", [1, 2, 3]), (16, b"\0\x01\0\x02\0\x03", [1, 2, 3])):
        (track,) = media.probe(media.box(b"moov", media.box(b"trak", media.full(b"stz2", 0, bytes(3), bytes([bits]), num(3), raw))))
        assert track.tables["sizes"].tolist() == want


def test_media_digests_through_tables(spark, docs):
    rows = media.digests(docs, "doc_id", "text").collect()
    assert len(rows) == docs.count() and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in rows)
    twice = [r for r in rows if r["doc_id"] == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert media.digests(docs.limit(0), "doc_id", "text").count() == 0


def test_media_many_chunk_runs():
    data = media.pack(bytes(range(256)) * 9 * 50, unit=36, per_chunk=7)
    (track,) = media.probe(data)
    assert media.read_back(data, track) == bytes(range(256)) * 9 * 50


def test_restore_disguised_words(spark):
    words = ["stupid", "idiot", "table", "window", "letter", "stone"] * 40
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    model = toxicity.letter_model(toxicity.letter_counts(df, "text"))
    for span in ("id10t", "1d1ot", "stup1d", "s t u p i d", "s.t.u.p.i.d", "$tupid", "stuuupid", "w1nd0w"):
        plain = toxicity.restore(span, model)
        assert plain in {"idiot", "stupid", "window"}, (span, plain)


def test_spaced_and_long_disguises(spark):
    words = ["stupid", "idiot", "bad", "table", "window", "letter", "stone"] * 40
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    reader = toxicity.Reader(toxicity.letter_model(toxicity.letter_counts(df, "text")))
    spans = ["i d i o t", "1 d 1 o t", '"i d i o t"', "i.d.i.o.t,", "i d i o t!", "i  d  i  o  t", "i. d. i. o. t.", "(i-d-i-o-t)", "5 i d i o t", "a 1 d 1 o t", "i d i o t  s t o n e", "i d i o t. s t o n e", "1di" + "o" * 50 + "t"]
    for span in spans:
        assert "=idiot" in reader.terms(f"such {span} there"), span
    assert "=bad" in reader.terms("so b a d, really") and "=stone" in reader.terms("i d i o t  s t o n e")
    assert not toxicity.spaced("in 1 2 3 4 steps, I am a man")


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        t = prose(rng, 40)
        if toxic:
            bad = rng.choice(["blockhead", "scumbag", "bl0ckhead", "s c u m b a g", "scuuumbag"])
            t = t.replace(" ", f" {bad} ", 1)
        rows.append((i, t))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "scumbag")]
    labels += [(None, 1), (902, None)]
    out = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i in held)
    right = sum(out[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert out[900]["score"] == out[901]["score"] < 0.5 < out[902]["score"]


def test_toxicity_of_odd_tables(spark):
    docs = "doc_id bigint, text string, score string, held_out int, __y int"
    labels = "doc_id bigint, toxic int, text string"
    none = spark.createDataFrame([], docs)
    assert toxicity.scored(none, spark.createDataFrame([], labels)).collect() == []
    some = spark.createDataFrame([(1, "a scumbag", "x", 1, 1), (1, "a scumbag", "x", 1, 1), (2, None, None, None, None), (None, "a", "", 0, 0)], docs)
    assert [r["score"] for r in toxicity.scored(some, spark.createDataFrame([], labels)).collect()] == [0.0] * 4
    out = toxicity.scored(some, spark.createDataFrame([(1, 1, "t"), (2, 0, None), (None, 1, "")], labels)).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_evidence_counts_each_sign_once():
    lexicon = {"=hateful": 3.0, "hate": 2.5, "=idiot": 4.0}
    assert toxicity.evidence({("=hateful", "hate", "hatef")}, lexicon) == 3.0
    assert toxicity.evidence({("=hateful", "hate"), ("=hated", "hate"), ("=idiot", "idio"), ("=nice",)}, lexicon) == 3.0 + 2.5 + 4.0
    assert toxicity.evidence({("=hater", "hate"), ("=hates", "hate")}, lexicon) == 2.5
    assert toxicity.evidence(set(), lexicon) == 0.0


def test_logistic_curve():
    rng = np.random.default_rng(3)
    x = rng.normal(2, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(-3 + 0.8 * x)))).astype(float)
    at, slope = toxicity.logistic(x, y)
    assert abs(at + 3) < 0.15 and abs(slope - 0.8) < 0.05
    at, slope = toxicity.logistic(np.array([0.0] * 50 + [9.0] * 10), np.array([0.0] * 50 + [1.0] * 10))
    assert at < -2 and at + 9 * slope > 2  # separable: finite, on the right sides
    assert toxicity.logistic(np.array([0.0, 1.0] * 30), np.array([1.0, 0.0] * 30))[1] >= 0
    once = toxicity.logistic(np.array([0.0, 0.0, 0.0, 2.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0, 1.0]))
    assert np.allclose(once, toxicity.logistic(np.array([0.0, 0.0, 2.0]), np.array([0.0, 1.0, 1.0]), np.array([2.0, 1.0, 2.0])))


def plain_kneser_ney(texts, order):
    """log p(byte | context) by the definition, over tuples of symbols."""
    tables = [collections.Counter()]
    for t in texts:
        c = [0] * (order - 1) + [b + 1 for b in t.encode()] + [0]
        tables[0].update(tuple(c[i : i + order]) for i in range(len(c) - order + 1))
    for _ in range(order - 1):
        tables.append(collections.Counter(g[1:] for g in tables[-1]))
    tables.reverse()
    off = []
    for t in tables:
        d = kneser_ney.discounts(*[sum(c == i for c in t.values()) for i in (1, 2, 3, 4)])
        off.append(lambda c, d=d: d[min(c, 3) - 1] if c else 0.0)

    def p(g):
        k = len(g)
        if not k:
            return 1 / kneser_ney.KINDS
        t, d = tables[k - 1], off[k - 1]
        same = [c for h, c in t.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(t[g] - d(t[g]), 0) / sum(same) + sum(map(d, same)) / sum(same) * p(g[1:])

    return p


def test_kneser_ney_equals_a_plain_model(spark):
    rng = random.Random(1)
    trusted = [prose(rng, 12) for _ in range(6)] + ["\x00 \xff é日", trusted_twice := "over and over"] + [trusted_twice]
    df = spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3)
    model = kneser_ney.held(kneser_ney.tables(kneser_ney.counts(df)))
    p = plain_kneser_ney(trusted, kneser_ney.ORDER)
    symbols = lambda g: tuple(g >> kneser_ney.BITS * i & 511 for i in range(kneser_ney.ORDER - 1, -1, -1))
    for text in [trusted[0][:40], "new words é", "\x00"]:
        keys = kneser_ney.grams(text)
        assert np.allclose(model.log_p(keys), [np.log(p(symbols(int(g)))) for g in keys], atol=1e-5)
    context = int(kneser_ney.grams(trusted[0])[7]) >> kneser_ney.BITS << kneser_ney.BITS
    assert np.exp(model.log_p(np.array([context + s for s in range(kneser_ney.KINDS)]))).sum() == pytest.approx(1, abs=1e-4)


def test_kneser_ney_separates(spark, docs):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80) if i % 5 else "#%& ".join(prose(rng, 80).upper().split()), ["en", "de", None][i % 3]) for i in range(200)]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 200, 2)]
    out = kneser_ney.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert sum(r["kept"] != (r["doc_id"] % 5 != 0) for r in out) <= 4
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = kneser_ney.classify(docs.select("doc_id", "text", "lang"), none).collect()
    assert len(odd) == docs.count() and all(r["kept"] == (r["perplexity"] is not None) for r in odd)
    assert kneser_ney.classify(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("most_held", [0, 40, 1 << 18])
def test_kneser_ney_counts_all_trusted_text(spark, most_held):
    cases = [f"no {w} is like an{w}" for w in ("other", "é", "日本", "x", "y" * 30)]
    n = 20_300
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, cases)), (F.sqrt("id") % 5 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"))
    more = ["no new word", "\x00!", cases[0], cases[0] + cases[3] * 2]
    df = df.unionByName(spark.createDataFrame([(n + i, t, "en") for i, t in enumerate(more)], df.schema))
    out = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(df, spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), most_held=most_held).collect()}
    assert len(out) == n + len(more)
    p = plain_kneser_ney([cases[int(i**0.5 % 5)] for i in range(n)], kneser_ney.ORDER)
    for i, t in [*[(i, cases[int(i**0.5 % 5)]) for i in (0, 1, 4, 9, 16, n - 1)], *enumerate(more, n)]:
        keys = [tuple(int(g) >> kneser_ney.BITS * k & 511 for k in range(kneser_ney.ORDER - 1, -1, -1)) for g in kneser_ney.grams(t)]
        assert out[i] == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in keys])), rel=1e-6)
    assert out[n + 2] == out[0]


def plain_components(rows):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, up = [sh(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_jaccard_join_matches_brute_force(spark, texts):
    rng = random.Random(9)
    rows = list(enumerate(t for t in texts))
    long = [f"w{rng.randint(0, 900)}" for _ in range(400)]
    for k in range(60):  # near copies on both sides of the limit
        w = list(long)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
        rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for tokens in (4_000_000, 5_000):  # one tile a block, and several
        out = jaccard_join.near_duplicates(df, tile_tokens=tokens, heavy=8)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == plain_components(rows)


def test_jaccard_join_links_short_texts_whose_common_tokens_are_not_sampled(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):  # sets of 4 to 12 shingles, with one of one more: linked, some without a sampled token in common
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(8, 16))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "more"]))]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) == 150
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_jaccard_join_edges(docs):
    out = jaccard_join.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    twice = [r for r in out if r["doc_id"] == 2]
    assert len(twice) == 2 and sum(r["first"] for r in twice) == 1
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def small_network(hidden=4):
    rng = np.random.default_rng(0)
    head = [(b"a", 30), (b"b", 20), (b"c", 9), (b"d", 8), (recurrent_lm.END, 5)]
    v = recurrent_lm.Vocabulary(head, np.where(np.arange(recurrent_lm.SHAPES) % 3, 0.5, 0.1), 80, 20, 3)
    p = {k: x.astype(np.float64) + rng.normal(0, 0.1, x.shape) for k, x in recurrent_lm.initial(v, hidden).items()}
    return recurrent_lm.Network(v, p), rng


def test_recurrent_model_is_a_distribution():
    net, rng = small_network()
    h, k = rng.normal(0, 1, (1, 4)), len(net.v.words)
    codes = [*range(k), *[k + recurrent_lm.BUCKETS * s for s in np.unique(net.v.tail, return_index=True)[1]]]
    assert sum(np.exp(net.log_p(h, np.array([y]))[0]) for y in codes) == pytest.approx(1, abs=1e-9)


def test_recurrent_gradients_hold_through_a_window():
    net, rng = small_network()
    k = len(net.v.words)
    y = rng.integers(0, k + 3 * recurrent_lm.BUCKETS, (7, 3)).astype(np.int32)
    y[:4] %= k
    y[5:, 2] = -1  # the third lane ends
    x = np.maximum(np.concatenate([np.full((1, 3), 4, np.int32), y[:-1]]), 0)
    fresh = np.zeros((7, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    h = rng.normal(0, 1, (3, 4))
    log, _, g = net.gradients(x, y, fresh, h)
    assert len(log) == (y >= 0).sum()
    rows, ge = g["E"]
    dense = np.zeros_like(net.p["E"])
    dense[rows] = ge
    g["E"] = dense
    for name, p in net.p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p.shape) if name != "E" else (rng.choice(rows), rng.integers(0, p.shape[1]))
            keep, vals = p[at], []
            for e in (1e-5, -1e-5):
                p[at] = keep + e
                vals.append(-net.gradients(x, y, fresh, h)[0].sum())
            p[at] = keep
            assert (vals[0] - vals[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-5), name


def test_recurrent_words_by_number():
    import pyarrow as pa

    texts = ["The cat\tTHE  cat", None, "", "é \x0b日本 the", "x" * 70_000 + " " + "x" * 69_999, " end ", "ab ba a b aab aba", "\x1c\x85 \xa0the"]
    numbers, shapes, ends = recurrent_lm.hashed(pa.array(texts, pa.string()).slice(0))
    words = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None] for t in texts]
    flat = [w for ws in words for w in ws]
    assert ends.tolist() == np.cumsum([len(ws) for ws in words]).tolist()
    known = {}
    for w, n, s in zip(flat, numbers.tolist(), shapes.tolist(), strict=True):
        assert known.setdefault(w, (n, s)) == (n, s)
        if w is not None:
            assert s == recurrent_lm.shape_table()[w[-1]] + (0 if w.isascii() else 32)
    assert len({n for n, _ in known.values()}) == len(known) and known[None][0] == recurrent_lm.END
    part = recurrent_lm.hashed(pa.array(texts, pa.string()).slice(3, 2))
    assert part[0].tolist() == numbers[ends[2] : ends[4]].tolist()


def test_recurrent_lanes_equal_documents_one_by_one():
    net, rng = small_network()
    k = len(net.v.words)
    docs = [np.append(rng.integers(0, k + recurrent_lm.BUCKETS, n - 1), 4).astype(np.int32) for n in (1, 90, 3, 40, 33, 1, 5, 64, 200, 2)]

    def plain(d):
        h, total, last = np.zeros((1, 4)), 0.0, 4
        for y in d:
            states, _ = net.states(net.v.inputs_of(np.array([[last]])), np.zeros((1, 1), bool), h, False)
            h = states[-1]
            total += net.log_p(h, np.array([y]))[0]
            last = y
        return total

    assert np.allclose(net.score([*docs], 4), [plain(d) for d in docs], atol=1e-4)
    assert sorted(recurrent_lm.Lanes(docs, 512).order) == list(range(10)) and recurrent_lm.Lanes(docs, 512).y.shape[1] == 2
    parts = list(recurrent_lm.portions(docs, 100))
    assert sum(parts, []) == docs and all(sum(map(len, p)) <= 100 or len(p) == 1 for p in parts)


def test_recurrent_chunks_are_bounded_by_bytes(spark):
    rows = [(i, "x" * (3000 if i % 7 == 0 else 10)) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = recurrent_lm.chunked(df.select(F.monotonically_increasing_id().alias("uid"), "text"), 2000).collect()
    assert len(got) == 201
    by = collections.defaultdict(list)
    for r in got:
        by[r["chunk"]].append(len(r["text"] or "") + 64)
    assert all(sum(x) - 64 <= 2000 + 64 * len(x) or len(x) == 1 for x in by.values()) and len(by) > 20


def test_recurrent_vocabulary_grows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recurrent_lm, "averaged", lambda texts, v, start, rate: (seen.append(v), start)[1])
    rows = [(i, " ".join(f"w{(i * 40 + k) % 3000}" for k in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert recurrent_lm.scored(df).count() == 300
    assert len(seen[0].words) >= 2048 and seen[0].groups >= 36
    recurrent_lm.scored(df, head=10, classes=2)  # about 11,000 training tokens
    assert len(seen[-1].words) >= 100 and seen[-1].groups >= 5
    assert recurrent_lm.vocabulary_size(10**12, 2048, 40) == (80_000, 200)


def test_recurrent_rounds_have_tasks_by_their_share(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recurrent_lm, "averaged", lambda texts, v, start, rate: (seen.append((texts.rdd.getNumPartitions(), texts.count())), start)[1])
    monkeypatch.setattr(recurrent_lm, "store", lambda df, tag: df.persist())
    monkeypatch.setattr(recurrent_lm, "drop_stored", lambda spark, df: None)
    df = spark.createDataFrame([(i, f"some words {i} " * 40) for i in range(240)], "doc_id bigint, text string").repartition(4)
    assert recurrent_lm.scored(df, chunk_bytes=5_000).count() == 240
    (a, _), (b, _), (c, _) = seen
    assert 1 <= a < b < c and sum(rows for _, rows in seen) == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(240))


def test_recurrent_distinct_numbers():
    numbers = np.array([7, -3, 7, 7, 0, -3, 9], np.int64)
    words, first, at = recurrent_lm.distinct_of(numbers)
    assert words.tolist() == [7, -3, 0, 9] and first.tolist() == [0, 1, 4, 6] and words[at].tolist() == numbers.tolist()
    assert [len(x) for x in recurrent_lm.distinct_of(numbers[:0])] == [0, 0, 0]


def test_recurrent_scores(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join(["alpha", "beta", "gamma", "delta"] * rng.randint(5, 30))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "new wörds only")]
    out = {r["doc_id"]: r for r in recurrent_lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    count = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update([*(t or "").split(), "\n"])
    n, v = sum(count.values()), len(count)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i, t in rows:
        ws = [*(t or "").split(), "\n"]
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert np.isfinite(r["score"])
    bits = lambda name: -sum(out[i][name] for i in held) / np.log10(2) / sum(out[i]["n_tokens"] for i in held)
    assert bits("score") < bits("base_score") - 1.5  # a cycle of four words: 2 bits a word without their order
    odd = recurrent_lm.scored(docs)
    assert odd.count() == docs.count()
    assert recurrent_lm.scored(docs.limit(0)).count() == 0


def test_url_rules_match_plain_ones(spark):
    urls = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=/de/", "x.org/es", None, "", "ftp://com/fr/", "http://a.com/fr/x", "http://acom/fr/x", "http://b.com/de/1#f", "http://org", "http://org/", "http://a.b.org:80/x", "http://x.net/en/7", "://", "a\n://b.org/\nq"]
    rows = [(i, u, "old") for i, u in enumerate(urls)]
    out = {r["page_id"]: r["filter"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string, filter string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r, _ in url_filters.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        if rule:
            assert out[i]["verdict"] == dict(url_filters.RULES)[rule]


def test_url_tree_rejects_a_bad_branch(spark):
    rows = [(f"http://shop.com/{'de' if k % 2 else 'fr'}/{k}",) for k in range(80)] + [(f"http://shop.com/it/{k}",) for k in range(5)]
    rows += [(f"http://pills.com/de/{k}",) for k in range(40)] + [("http://pills.com/it/3",), ("http://fine.com/fr/1",), ("http://fine.com/it/1",)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string")
    out = {r["url"]: r["filter"] for r in url_filters.judge(df).collect()}
    assert out["http://pills.com/it/3"]["verdict"] == "block"
    assert out["http://shop.com/de/1"]["template"] == "/de/*"
    assert url_filters.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("sections", [2, 60])
def plain_templates(rows, z=3.0, strength=5.0):
    """(host, folded path) -> (template, share), level by level for each host; rows: host, folded path, n, labelled, blocked."""
    root = (sum(r[4] for r in rows) + 1) / (sum(r[3] for r in rows) + 2)
    out = {}

    todo = []
    for host in {r[0] for r in rows}:
        node = [r for r in rows if r[0] == host]
        todo.append((node, "", (sum(r[4] for r in node) + strength * root) / (sum(r[3] for r in node) + strength), 0))
    while todo:
        node, t, p, k = todo.pop()
        kids = collections.defaultdict(list)
        for r in node:
            s = [x for x in r[1].split("/") if x]
            kids[s[k] if k < len(s) else ""].append(r)
        labels = collections.defaultdict(list)
        ln, lb = sum(r[3] for r in node), sum(r[4] for r in node)
        for s, own in kids.items():
            n, b = sum(r[3] for r in own), sum(r[4] for r in own)
            q = lb / ln if ln else 0
            apart = 0 < n < ln and abs(b / n - (lb - b) / (ln - n)) > z * (q * (1 - q) * (1 / n + 1 / (ln - n))) ** 0.5
            wild = s.startswith("{") and not s.startswith("{{")
            labels["" if s == "" else "*" if wild or not apart else "%2A" if s == "*" else s].extend(own)
        for label, own in labels.items():
            below = (sum(r[4] for r in own) + strength * p) / (sum(r[3] for r in own) + strength)
            if label == "":
                out.update({(r[0], r[1]): (t, below) for r in own})
            else:
                todo.append((own, f"{t}/{label}", below, k + 1))
    return out


def test_url_templates_equal_the_plain_tree(spark):
    rng = random.Random(21)
    urls = []
    for host in ("a.org", "example.org", "x.com", "y.com", "z.net"):
        for _ in range(160):
            depth = rng.choice([0, 1, 2, 3, 3, 5, 9])
            first = rng.choice(["en", "es", "de", "fr", "*", "{odd}", "2020-01-02", "abc7"])
            urls.append(f"http://{host}/" + "/".join([first, *(rng.choice(["p", "q", "17", "deadbeef99"]) for _ in range(depth))][: depth + 1]))
    deep = "http://z.net/deep/" + "/".join(str(k) if k % 3 else "seg" for k in range(1000))
    urls += [deep, deep + "/end", None, "nothing", "http://x.com", "http://x.com//"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = [r["filter"] for r in url_filters.judge(df).collect()]
    folds = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filters.parts(F.col("url")).alias("u"))
    folds = folds.select("u.host", F.array_join(F.transform(F.filter(F.split("u.path", "/"), lambda x: x != ""), url_filters.lexical), "/").alias("f"), url_filters.rule_of(F.col("u.host"), F.col("u.path")).alias("rule"))
    counts = collections.Counter()
    for r in folds.collect():
        block = dict(url_filters.RULES).get(r["rule"]) == "block"
        for k, v in (("n", 1), ("l", r["rule"] is not None), ("b", block)):
            counts[r["host"], r["f"], k] += v
    keys = {k[:2] for k in counts}
    want = plain_templates([(h, f, counts[h, f, "n"], counts[h, f, "l"], counts[h, f, "b"]) for h, f in keys])
    assert collections.Counter((r["host"], r["template"], round(r["purity"], 9)) for r in got) == collections.Counter(
        (h, want[h, f][0], round(want[h, f][1], 9)) for h, f in keys for _ in range(counts[h, f, "n"])
    )


def test_url_tree_keeps_branches_apart_at_any_width(spark, sections):
    rows = [f"http://shop.com/{s}/{c}" for s in ("de", "fr") for c in "abcdefgh" for _ in range(10 if s == "de" else 4)]
    rows += ["http://shop.com/it/a", *[f"http://shop.com/{chr(97 + k // 26)}{chr(97 + k % 26)}x/a" for k in range(sections)]]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")
    out = {r["url"]: r["filter"] for r in url_filters.judge(df).collect()}
    assert [out[f"http://shop.com/{s}/a"]["template"] for s in ("de", "fr", "it")] == ["/de/*", "/fr/*", "/*/*"]
    assert out["http://shop.com/fr/a"]["purity"] < 0.3 and out["http://shop.com/de/a"]["purity"] > 0.9


def test_url_tree_reads_the_whole_path(spark):
    rules = (("com/a/b/c/bad/x", "block"), ("com/a/b/c/good/x", "allow"))
    rows = [f"http://s.com/a/b/c/{s}/x{c}" for s in ("bad", "good") for c in "abcdefgh" for _ in range(5)] + [f"http://s.com/a/b/c/{s}/y" for s in ("bad", "good")] + ["http://s.com", "http://t.com/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")
    got = url_filters.judge(df, rules=rules).collect()
    out = {r["url"]: r["filter"] for r in got}
    assert len(got) == len(rows) and all(r["filter"]["purity"] is not None for r in got)
    assert (out["http://s.com/a/b/c/bad/y"]["verdict"], out["http://s.com/a/b/c/good/y"]["verdict"]) == ("block", "allow")
    assert out["http://s.com/a/b/c/bad/y"]["template"] == "/*/*/*/bad/*"


def test_pipeline_on_small_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 60) + ".\n" + (passage if i % 10 == 0 else prose(rng, 30)) + ".", "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + k, rows[1][1], "en", "s1", 0) for k in range(5)] + [(200, "a b", "en", "s0", 0), (201, "go " * 300, "en", None, 0), (202, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert sorted(ids) == list(range(60)) and all(r["round_trip"] for r in out)
    own = bpe.load(VOCABULARY)
    texts = {r["doc_id"]: own.decode(r["ids"]) for r in out}
    assert sum(passage in t for t in texts.values()) == 1 and passage in texts[0]
