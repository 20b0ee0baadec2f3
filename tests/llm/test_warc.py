"""Archives: round trips at any split size, false magics, damage, repeated payloads, nulls, ties and clashing columns."""

import base64
import collections
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackmill.llm import warc

SCHEMA = "page_id bigint, url string, html string, h string, first string, n int, payload string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "f", 1, "p", "k") for r in rows], SCHEMA).repartition(3)


def pages():
    rng = random.Random(2)
    rows = [(i, f"https://h{i % 7}.org/a b?q={i}\r\nX: é", "<p>" + " ".join(rng.choice(["alpha", "béta", "日本"]) for _ in range(rng.randint(0, 400)))) for i in range(100)]
    rows += [(1000 + i, "http://copy.org/", "the same text") for i in range(40)] + [(2000 + i, None, None if i % 2 else "") for i in range(20)]
    rows += [(None, "http://none.org", "no key"), (None, None, "the same text"), (1039, "http://copy.org/", "the same text"), (-5, "u", "x" * 3_000_000), (-6, "u", "x" * 3_000_000)]
    return rows


def wanted(rows, least=0):
    largest = {}
    for k, _, t in rows:
        p = (t or "").encode()
        largest[p] = max((x for x in (largest.get(p), k) if x is not None), default=None)
    out = collections.Counter()
    for k, _, t in rows:
        p = (t or "").encode()
        revisit = len(p) >= least and k != largest[p]
        out[k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", largest[p] if revisit else None, True] += 1
    return out


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip_and_revisits(spark, least):
    rows = pages()
    got = collections.Counter(tuple(r) for r in warc.round_trip(frame(spark, rows), least=least).collect())
    assert got == wanted(rows, least)


def test_text_keys_keep_their_characters(spark):
    df = spark.createDataFrame([("a:b>%+ é", "u", "t"), ("", "u", "t"), ("a", "u", "t"), (None, "u", "z")], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {"a:b>%+ é": ("response", None), "": ("revisit", "a:b>%+ é"), "a": ("revisit", "a:b>%+ é"), None: ("response", None)}


def test_empty_table_gives_an_archive_without_records(spark):
    assert warc.round_trip(frame(spark, pages()).limit(0)).count() == 0


@pytest.mark.parametrize("split", [700, 4096])
def test_any_split_gives_the_same_records_once(spark, tmp_path, split):
    rows = pages()[:40]
    warc.write(frame(spark, rows), f"file://{tmp_path}/a")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read(spark, f"file://{tmp_path}/a").where("kind = 'response'").select(F.col("key").cast("long"), F.col("payload").cast("string"), "intact").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert collections.Counter(map(tuple, got)) == collections.Counter((k, t or "", True) for k, _, t in rows if wanted(rows)[k, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response", None, True])


def stored(data):
    """A member whose bytes stand as they are."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("split", [150, 5000])
def test_magics_inside_payloads_are_no_records(spark, tmp_path, split):
    rng = random.Random(7)
    rows = []
    for i in range(25):
        junk = b"".join(rng.choice([warc.MAGIC, warc.MAGIC + b"\x00" * 7, warc.SEPARATOR, gzip.compress(b"other"), rng.randbytes(9), b"text "]) for _ in range(rng.randint(0, 30)))
        rows.append((f"{i}", junk))
    body = b""
    for k, p in rows:
        plain = zlib.decompress(warc.page_record(k, "u", p, None, "d"), 31)
        body += rng.choice([stored, warc.member])(plain) + rng.choice([b"", warc.SEPARATOR, b"\0\0\0"])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read(spark, f"file://{tmp_path}/b").select("key", "payload", "kind", "intact").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["key"], bytes(r["payload"]), r["kind"], r["intact"]) for r in got) == sorted((k, p, "response", True) for k, p in rows)


def test_damage_leaves_other_records_alone(spark, tmp_path):
    members = [warc.page_record(f"{i}", "u", f"payload {i} ".encode() * 50, None, "d") for i in range(6)]
    members[2] = members[2][:-30]
    broken = bytearray(members[4])
    broken[len(broken) // 2] ^= 255
    members[4] = bytes(broken)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc").write_bytes(warc.SEPARATOR.join(members))
    got = warc.read(spark, f"file://{tmp_path}/c").collect()
    assert sorted(r["key"] for r in got if r["kind"] == "response" and r["intact"]) == ["0", "1", "3", "5"]
    assert [r["kind"] for r in got].count("damaged") == 2


def test_files_are_plain_gzip(spark, tmp_path):
    rows = pages()[:20]
    warc.write(frame(spark, rows), f"file://{tmp_path}/d")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "d").glob("part-*"))
    assert text.count(b"WARC-Type: response\r\n") == len({t for _, _, t in rows})
    assert text.count(b"WARC/1.1\r\n") == len(rows) + text.count(b"WARC-Type: warcinfo\r\n")
    assert text.endswith(b"\r\n\r\n")
