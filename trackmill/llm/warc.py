"""WARC archives: written with revisit records for repeated payloads, read in splits of any size.

Writing: each record is a gzip member of its own. Of rows with equal payloads of at least `least` bytes
those with the largest key become `response` records, which hold the payload; the others become `revisit`
records that name the response, its digest and length. A task writes one file, which begins with a
`warcinfo` record. Members are written by Spark's own text sink, whose line separator is an empty gzip
member: any gzip reader decodes the file to plain WARC text, on any file system that Spark writes to.

Reading: Spark's text source cuts files into byte ranges, and its line separator is the magic of a gzip
member. So the task of a range scans it for magics, and owns the pieces that start inside, read to their
end beyond the range. A piece need not be a member, for payload bytes may look like a magic: a
candidate begins a record only if it decodes to `WARC/`, and takes on further pieces until the member
ends. What a range's last member still lacks, and pieces before the first record of a range, are loose: they are brought together by file, in order, and
joined there. Loose pieces are rare, one for each range and false magic at most, and less than a file. Decoded records are stored
once, so nothing is decoded twice and a lost executor costs its ranges only.

Sizes: rows leave the workers in batches of some megabytes. Payloads are digested in the task that reads them; with keep_payload=False
only their lengths and digests are stored. Payloads that a thousandth of the rows share, at most a thousand, meet their response by
broadcast, the others in a shuffle.

Defined results: a null or empty payload has no bytes and the digest of nothing; it takes part in revisits if least is 0. Rows that share the
largest key of a payload all become responses (and are refered to by their greatest url); a null key is the smallest. Null urls have no target header, characters that can't stand in a header are
percent-encoded. Repeated rows give repeated records; an empty table gives an archive without records, which reads
as an empty table; other columns are not read. A member that is cut off or broken gives a row of type `damaged` without payload, other records are
not affected. Not defined: a payload that holds whole WARC members, stored without compression, across the border of two ranges. Names that end in .gz are opened as
one stream by Spark; give such files another name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.common import join_hot, shared_dir, store

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes, which separates records.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4_000_000
FIELDS = "file string, at bigint, seq bigint, kind string, key string, record_id string, url string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean, payload binary, loose binary"
_BAD_IN_HEADER = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def member(data: bytes) -> bytes:
    """data as one gzip member, without a name or time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str | None, url: str | None) -> str:
    """A name that tells the key and differs by url."""
    tag = hashlib.sha256(f"{'' if url is None else '=' + url}".encode()).hexdigest()[:32]
    return f"<urn:record:{'none' if key is None else 'k' + quote(key, safe='')}:{tag}>"


def key_of(name: str | None) -> str | None:
    part = (name or "").split(":")
    return unquote(part[2][1:]) if len(part) == 4 and part[2].startswith("k") else None


def header_text(value: str) -> str:
    return _BAD_IN_HEADER.sub(lambda m: quote(m[0], safe=""), value)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(lines).encode() + block + b"\r\n\r\n")


def page_record(key: str | None, url: str | None, payload: bytes, first: dict | None, date: str) -> bytes:
    """first: key and url of the response that holds the payload; None or the row itself: this is the response."""
    size = len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(key, url)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", header_text(url)))
    if first is None or first["key"] == key:
        return record("response", fields, head + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["key"], first["url"]))]
    if first["url"] is not None:
        fields.append(("WARC-Refers-To-Target-URI", header_text(first["url"])))
    return record("revisit", fields, head)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record for each row into new files in the folder `path`."""
    k, u, body = (F.col(f"`{c}`") for c in (key, url, payload))
    rows = pages.select(k.alias("key"), u.cast("string").alias("url"), F.coalesce(body.cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("h", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    holders = rows.where("h is not null").groupBy("h").agg(F.max(F.struct("key", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    holders = store(holders.select("h", F.struct(F.col("first.key").cast("string").alias("key"), F.col("first.url").alias("url")).alias("first"), "n"), "holders")
    rows = join_hot(rows, holders, ["h"], "n", pages.count(), "left").select(F.col("key").cast("string").alias("key"), "url", "payload", "first")

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, begun = [], 0, False
        for batch in batches:
            for r in range(batch.num_rows):
                if not begun:
                    name = f"<urn:uuid:{uuid.uuid4()}>"
                    made.append(record("warcinfo", [("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    begun = True
                made.append(page_record(*[batch.column(c)[r].as_py() for c in range(4)], date))
                size += len(made[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    text = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def parsed(data: bytes, keep_payload: bool) -> dict | None:
    """What a decoded record tells; None for records that are no pages."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return None
    size = fields.get("content-length", "")
    whole = size.isdigit() and len(block) >= int(size)
    block = block[: int(size)] if whole else block
    http, cut, payload = block.partition(b"\r\n\r\n")
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"kind": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "loose": None}
    out["key"] = key_of(out["record_id"])
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        return out | {"payload_bytes": int(length[1]) if length else None, "payload_digest": told or None, "intact": whole, "payload": None}
    found = digest(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": found, "intact": whole and bool(cut) and told in ("", found), "payload": payload if keep_payload else None}


NOTHING = dict.fromkeys(("kind", "key", "record_id", "url", "refers_to", "payload_bytes", "payload_digest", "intact", "payload", "loose"))
DAMAGED = NOTHING | {"kind": "damaged", "intact": False}


class Member:
    """A gzip member that takes on pieces until it ends."""

    def __init__(self) -> None:
        self.unpack, self.out, self.raw, self.head, self.broken = zlib.decompressobj(31), [], [], b"", False

    def take(self, data: bytes) -> None:
        self.raw.append(data)
        try:
            if len(self.head) < 5:  # a broken member's beginning still tells what it was
                self.head += self.unpack.decompress(data, 5 - len(self.head))
                data = self.unpack.unconsumed_tail
            self.out.append(self.unpack.decompress(data))
        except zlib.error:
            self.broken = True

    @property
    def possible(self) -> bool:
        """Nothing yet says that this is no record."""
        return not self.broken and b"WARC/".startswith(self.head)

    @property
    def sure(self) -> bool:
        return self.head == b"WARC/"


def decoded(pieces: Iterable[bytes], whole_file: bool, keep_payload: bool) -> Iterator[dict]:
    """The records of consecutive pieces, each from a magic on. Pieces that belong to none are loose, or dropped where no others can follow."""
    left, todo, now = iter(pieces), deque(), None
    aligned = whole_file  # the next piece follows the end of a record, so it can't belong to an earlier one
    while True:
        data = todo.popleft() if todo else next(left, None)
        if data is None and now is None:
            return
        if data is None and not whole_file:  # the member may go on in the next range
            yield from (NOTHING | {"kind": "loose", "loose": x} for x in now.raw)
            return
        if data is not None:
            if data == SEPARATOR and now is None and aligned:
                continue
            now = now or Member()
            now.take(data)
            if now.possible and not now.unpack.eof:
                continue
            if now.possible and (now.sure or aligned):
                found = parsed(now.head + b"".join(now.out), keep_payload) if now.sure else None
                now, aligned = None, True
                if found:
                    yield found
                continue
        aligned = whole_file
        if now.sure:
            yield DAMAGED
        elif not whole_file:
            yield NOTHING | {"kind": "loose", "loose": now.raw[0]}
        todo.extendleft(reversed(now.raw[1:]))  # one of them may begin a record
        now = None


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The page records in the files of `path`: kind, key, record_id, url, refers_to (key), payload_bytes, payload_digest, intact, payload.

    A response's length and digest are those of the bytes that were read; a revisit's are what it tells. intact: lengths and digests agree.
    """
    source = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).format("text").load(path)
    pieces = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))

    def by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
        def rows():
            for b in batches:
                for r in range(b.num_rows):
                    yield b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(2)[r].as_py()

        ahead = rows()
        row = next(ahead, None)
        while row is not None:
            place = row[:2]

            def same(place=place):
                nonlocal row
                if place[1] == 0 and row[2] == b"":  # what stands before the first magic of a file
                    row = next(ahead, None)
                while row is not None and row[:2] == place:
                    yield MAGIC + row[2]
                    row = next(ahead, None)

            pieces_here = same()
            yield place, pieces_here
            for _ in pieces_here:
                pass

    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, FIELDS.split(", "), strict=True)])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for (file, at), here in by_range(batches):
            for seq, x in enumerate(decoded(here, False, keep_payload)):
                made.append(x | {"file": file, "at": at, "seq": seq})
                size += 500 + len(x["payload"] or b"") + len(x["loose"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    found = store(pieces.mapInArrow(records, FIELDS), "records")

    def rejoined(one_file: pd.DataFrame) -> pd.DataFrame:
        rows = one_file.sort_values(["at", "seq"])
        out = [x | {"file": rows["file"].iloc[0], "at": rows["at"].iloc[0], "seq": n} for n, x in enumerate(decoded(rows["loose"], True, keep_payload))]
        return pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    loose = found.where("kind = 'loose'").groupBy("file").applyInPandas(rejoined, FIELDS)
    name = F.regexp_extract("refers_to", "^<urn:record:k([^:]*):", 1)
    refers = F.when(F.col("refers_to").rlike("^<urn:record:k"), F.url_decode(name))
    out = found.where("kind <> 'loose'").union(loose)
    return out.select("kind", "key", "record_id", "url", refers.alias("refers_to"), "payload_bytes", "payload_digest", "intact", "payload")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives of pages to the shared folder and read them back without keeping payloads; the key as it was."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, key, url, payload, least)
    kind = pages.schema[key].dataType
    return read(spark, path, keep_payload=False).select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "intact",
    )
