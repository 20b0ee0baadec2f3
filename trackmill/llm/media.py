"""ISO media containers: writing raw samples, walking nested boxes, decoding sample tables.

`probe` reads a container held in a binary value: it walks the boxes (32-bit, 64-bit and to-the-end
sizes), decodes the sample tables of each track (stsd, stts, stsc, stsz or stz2, stco or co64, stss) and of
fragments (trex, tfhd, trun) and returns codec, duration and the byte ranges of all samples and of the key frames. Payloads are
located, never decoded. `pack` stores bytes losslessly as fixed-size 8-bit samples in such a file.

Defined results: null or empty bytes, or bytes that are no container, have no tracks; a box that
claims more than its parent holds ends the walk of that parent; tables that disagree give the
samples that all of them cover, and counts that no table or file can hold are cut to what it holds. Nothing here depends on other rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 576
#: Boxes that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
TIMESCALE = 48_000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full(kind: bytes, version: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 appended up to a positive multiple of unit."""
    return payload + b"\xff" * (-len(payload) % unit if payload else unit)


def pack(payload: bytes, unit: int = UNIT, per_chunk: int = 64, key_every: int = 8) -> bytes:
    """A container with one track of 8-bit samples of `unit` bytes; len(payload) must be a multiple of unit."""
    n, extra = divmod(len(payload), unit)
    if extra:
        raise ValueError(f"{len(payload)} bytes are no multiple of {unit}")
    chunks = -(-n // per_chunk)
    identity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    runs = [(1, per_chunk, 1)] if n else []
    if n % per_chunk and chunks > 1:
        runs.append((chunks, n % per_chunk, 1))
    elif n % per_chunk:
        runs = [(1, n, 1)]

    def moov(start: int) -> bytes:
        places = start + np.arange(chunks, dtype=np.int64) * per_chunk * unit
        wide = start + len(payload) >= 2**32
        offsets = full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes())
        keys = np.arange(1, n + 1, key_every, dtype=">u4")
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, unit) if n else struct.pack(">I", 0)),
            full(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", 0, struct.pack(">II", unit, n)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 0))), stbl)
        mdhd = full(b"mdhd", 1, struct.pack(">QQIQHH", 0, 0, TIMESCALE, n * unit, 0x55C4, 0))
        hdlr = full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"\0")
        tkhd = full(b"tkhd", 1, struct.pack(">QQIIQ", 0, 0, 1, 0, n * unit), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), identity, bytes(8))
        mvhd = full(b"mvhd", 1, struct.pack(">QQIQ", 0, 0, TIMESCALE, n * unit), struct.pack(">IH", 0x10000, 0x100), bytes(10), identity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    lead = 8 if len(payload) + 8 < 2**32 else 16
    index = moov(len(head) + len(moov(0)) + lead)
    return head + index + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of kinds, start, start of the content, end) of each box, parents first; nests of any depth."""
    todo: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind, lead = int.from_bytes(data[start : start + 4], "big"), bytes(data[start + 4 : start + 8]), 8
        if size == 1 and start + 16 <= end:
            size, lead = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < lead or start + size > end:
            continue
        own = (*path[-8:], kind)  # no table lies deeper
        yield own, start, start + lead, start + size
        todo.append((start + size, end, path))
        if kind in NESTS:
            todo.append((start + lead, start + size, own))


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    number: int = 0
    tables: dict = field(default_factory=dict)
    #: Of each fragment's run: sample starts, ends, whether they stand alone.
    runs: list = field(default_factory=list)

    def listed(self) -> np.ndarray:
        """Byte ranges (start, end) of the samples that the sample tables list."""
        t = self.tables
        runs, places, sizes = t.get("stsc", np.zeros((0, 3), np.int64)), t.get("places", np.zeros(0, np.int64)), t.get("sizes", np.zeros(0, np.int64))
        if not len(runs) or not len(places) or not len(sizes):
            return np.zeros((0, 2), np.int64)
        run = np.searchsorted(np.maximum.accumulate(runs[:, 0]), np.arange(1, len(places) + 1), side="right") - 1
        ends = np.cumsum(np.where(run >= 0, np.minimum(runs[np.maximum(run, 0), 1], len(sizes)), 0))
        chunk_of = np.searchsorted(ends, np.arange(len(sizes)), side="right")
        chunk_of = chunk_of[chunk_of < len(places)]
        sizes = sizes[: len(chunk_of)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], ends])[:-1]
        start = places[chunk_of] + total[:-1] - total[np.minimum(first[chunk_of], len(sizes))]
        return np.stack([start, start + sizes], 1)

    def samples(self) -> np.ndarray:
        """Byte ranges (start, end) of the samples, those of fragments last."""
        return np.concatenate([self.listed(), *[np.stack(r[:2], 1) for r in self.runs]])

    def key_frames(self) -> np.ndarray:
        """Byte ranges of the samples that stand alone: those of stss, else all; in fragments those whose flags say so."""
        s, keys = self.listed(), self.tables.get("stss")
        s = s if keys is None else s[keys[(keys > 0) & (keys <= len(s))] - 1]
        return np.concatenate([s, *[np.stack(r[:2], 1)[r[2]] for r in self.runs]])


def fragment_run(view: memoryview, a: int, b: int, flags: int, of: dict) -> tuple | None:
    """(starts, ends, whether each stands alone, ticks) of a trun's samples, `of` being its traf's defaults; None where it is cut off."""
    n, at = int.from_bytes(view[a + 4 : a + 8], "big"), a + 8
    start, first = of["at"], None
    if flags & 1:
        start, at = of["base"] + int.from_bytes(view[at : at + 4], "big", signed=True), at + 4
    if flags & 4:
        first, at = int.from_bytes(view[at : at + 4], "big"), at + 4
    fields = [x for x in (0x100, 0x200, 0x400, 0x800) if flags & x]
    if fields:
        n = min(n, max(0, b - at) // (4 * len(fields)))
    elif of["size"]:
        n = min(n, len(view) // of["size"])
    else:
        n = 0
    rows = np.frombuffer(view, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields)) if n and fields else np.zeros((n, 0), np.int64)
    column = lambda bit, default: rows[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)
    sizes, marks = column(0x200, of["size"]), column(0x400, of["flags"]).copy()
    if n and first is not None:
        marks[0] = first
    ends = start + np.cumsum(sizes)
    of["at"] = int(ends[-1]) if n else start
    return ends - sizes, ends, marks & 0x10000 == 0, int(column(0x100, of["ticks"]).sum())


def table(data: memoryview, start: int, end: int, width: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    """The entries behind a count, as many as the box really holds."""
    if start + skip + 4 > end:
        return np.zeros((0, width), np.int64)
    n = int.from_bytes(data[start + skip : start + skip + 4], "big")
    item = np.dtype(kind).itemsize * width
    n = min(n, (end - start - skip - 4) // item)
    return np.frombuffer(data, kind, n * width, start + skip + 4).astype(np.int64).reshape(n, width)


def probe(data: bytes | None) -> list[Track]:
    """The tracks of a container."""
    view, tracks, defaults, moof, of = memoryview(data or b""), [], {}, 0, None
    word = lambda at, n=4: int.from_bytes(view[at : at + n], "big")
    for path, start, a, b in walk(view):
        kind = path[-1]
        if kind == b"moof":
            moof = start
        elif kind == b"trex" and b - a >= 24:
            defaults[word(a + 4)] = {"ticks": word(a + 12), "size": word(a + 16), "flags": word(a + 20)}
        elif kind == b"tfhd" and b - a >= 8:
            flags, at, number = word(a + 1, 3), a + 8, word(a + 4)
            of = {"ticks": 0, "size": 0, "flags": 0} | defaults.get(number, {}) | {"base": moof, "number": number}
            for bit, name, n in ((1, "base", 8), (2, "", 4), (8, "ticks", 4), (16, "size", 4), (32, "flags", 4)):
                if flags & bit:
                    of[name], at = word(at, n), at + n
            of["at"] = of["base"]
        elif kind == b"trun" and of and b - a >= 8:
            t = next((t for t in tracks if t.number == of["number"]), None)
            if t:
                *run, ticks = fragment_run(view, a, b, word(a + 1, 3), of)
                t.runs.append(run)
                t.duration += ticks
        if kind == b"trak":
            tracks.append(Track())
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd" and b - a >= 24:
            t.number = word(a + (20 if view[a] == 1 else 12))
        elif kind == b"mdhd" and b - a >= 20:
            at = 20 if view[a] == 1 else 12
            t.timescale, t.duration = word(a + at), word(a + at + 4, 8 if view[a] == 1 else 4)
        elif kind == b"hdlr":
            t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            t.tables["stts"] = table(view, a, b, 2)
        elif kind == b"stsc":
            t.tables["stsc"] = table(view, a, b, 3)
        elif kind in (b"stco", b"co64"):
            t.tables["places"] = table(view, a, b, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            t.tables["stss"] = table(view, a, b, 1)[:, 0]
        elif kind == b"stsz" and b - a >= 12:
            same, n = word(a + 4), word(a + 8)
            t.tables["sizes"] = np.full(min(n, len(view) // same), same, np.int64) if same else table(view, a, b, 1, skip=8)[:, 0]
        elif kind == b"stz2" and b - a >= 12:
            bits = view[a + 7]
            if bits in (8, 16):
                t.tables["sizes"] = table(view, a, b, 1, f">u{bits // 8}", skip=8)[:, 0]
            elif bits == 4:
                raw = np.frombuffer(view[a + 12 : b], np.uint8)
                t.tables["sizes"] = np.stack([raw >> 4, raw & 15], 1).ravel()[: word(a + 8)].astype(np.int64)
    return tracks


def read_back(data: bytes, track: Track) -> bytes:
    """The samples of a track, joined; neighbouring ranges are read at once."""
    s = track.samples()
    if not len(s):
        return b""
    cut = np.flatnonzero(s[1:, 0] != s[:-1, 1])
    return b"".join(data[a:b] for a, b in zip(s[np.append(0, cut + 1), 0], s[np.append(cut, len(s) - 1), 1], strict=True))


def describe(track: Track) -> str:
    """Codec, samples, duration in ticks and seconds, key frames with the first and last byte range."""
    keys = track.key_frames()
    ranges = [f"{a}-{b}" for a, b in (keys[0], keys[-1])] if len(keys) else []
    digest = hashlib.sha256(keys.astype("<i8").tobytes()).hexdigest()[:16]
    return (
        f"codec={track.codec.strip()};samples={len(track.samples())};ticks={track.duration};timescale={track.timescale};"
        f"seconds={track.duration / track.timescale if track.timescale else 0:.6f};keyframes={len(keys)};first_last={','.join(ranges)};ranges={digest}"
    )


def probe_column(df: DataFrame, media: str) -> DataFrame:
    """All rows and columns of df with `tracks`: handler, codec, timescale, duration and key frame byte ranges.

    Row by row in Arrow batches; memory holds one batch. A column named tracks is replaced.
    """
    kinds = "array<struct<handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,key_frames:array<struct<start:bigint,end:bigint>>>>"

    def rows(batches):
        for batch in batches:
            found = [
                [
                    {"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.samples()), "key_frames": [{"start": int(a), "end": int(b)} for a, b in t.key_frames()]}
                    for t in probe(x)
                ]
                for x in batch.column(media).to_pylist()
            ]
            keep = [c for c in batch.schema.names if c != "tracks"]
            kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("key_frames", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, kind)], [*keep, "tracks"])

    shape = df.drop("tracks")
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema], f"tracks {kinds}"])
    return df.mapInArrow(rows, fields)


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """Store a text as a container, read the stored samples back and describe both."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = pack(padded(raw))
    (track,) = probe(media)
    back = read_back(media, track)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(track)


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key and the columns of DIGEST."""

    def rows(batches):
        for batch in batches:
            done = [digest(x) for x in batch.column(1).to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*done, strict=True) if done else [[] for _ in kinds]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, *names])

    picked = df.select(key, text)
    return picked.mapInArrow(rows, f"`{key}` {picked.schema[0].dataType.simpleString()}, {DIGEST}")
