"""Media columns: ISO base media containers (MP4 and its kin) read without decoding a payload.

The walk goes through nested boxes by their sizes (32 and 64 bit, and "to the end"), decodes the sample tables of each track
(stsd, stts, stss, stsc, stsz or stz2, stco or co64) and the runs of its movie fragments (trex, tfhd, tfdt, trun), and yields
codec, duration and the byte range of each keyframe. A track without stss has keyframes only; in fragments the flag of a
sample says whether it is one. The codec of an encrypted entry is the one behind the encryption (frma). Seconds are decode
times on the track's own timeline: composition offsets and edit lists don't move them. The duration is that of mdhd or of all
samples, whichever is longer.

Defined results: null or empty bytes give no row; bytes without a readable movie box give one row with error set and nothing
else; a movie without tracks gives no row; a track whose tables don't fit together keeps what could be read (at least its
number in the file), has no keyframes, and error set, and the other tracks of the file aren't touched; fewer than eight bytes
after the last box are padding; a payload box that is cut off is read to the end; repeated rows give repeated rows; an empty
table gives an empty result. Only the id and payload columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import textkernel as K

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"}
SCHEMA = "doc_id long, track int, kind string, codec string, duration double, samples long, keyframes array<struct<sample:int,offset:long,size:long,seconds:double>>, error string"
_FRAMES = pa.list_(pa.struct([("sample", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("seconds", pa.float64())]))
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), _FRAMES, pa.string()]
_NAMES = ["doc_id", "track", "kind", "codec", "duration", "samples", "keyframes", "error"]
MAX_DEPTH = 16


@dataclass
class Box:
    """A box: where it starts, where its content starts and ends, and the boxes inside, if it is a container."""

    kind: bytes
    start: int
    a: int
    z: int
    inside: list[Box]

    def all(self, kind: bytes) -> list[Box]:
        return [x for x in self.inside if x.kind == kind]

    def one(self, *path: bytes) -> Box:
        at = self
        for kind in path:
            found = at.all(kind)
            if not found:
                raise ValueError(f"no {kind.decode('latin-1')} box")
            at = found[0]
        return at


def boxes(data: memoryview, at: int, end: int, depth: int = 0) -> Iterator[Box]:
    """The boxes between two places, with those inside the containers."""
    if depth > MAX_DEPTH:
        raise ValueError("boxes are nested too deeply")
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size >= head and at + size > end and depth == 0 and kind not in CONTAINERS:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"a box has a wrong size: {kind!r}")
        yield Box(kind, at, at + head, at + size, list(boxes(data, at + head, at + size, depth + 1)) if kind in CONTAINERS else [])
        at += size


def _table(data: memoryview, box: Box, kind: str, columns: int = 1, skip: int = 0) -> np.ndarray:
    n = struct.unpack_from(">I", data, box.a + 4 + skip)[0]
    start = box.a + 8 + skip
    width = np.dtype(kind).itemsize * columns
    if start + n * width > box.z:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, start).reshape(n, columns).astype(np.int64)


def _sizes(data: memoryview, stbl: Box) -> np.ndarray:
    """The size of each sample, from stsz or the compact stz2."""
    if stbl.all(b"stsz"):
        box = stbl.one(b"stsz")
        fixed, n = struct.unpack_from(">II", data, box.a + 4)
        if fixed and n > len(data):
            raise ValueError("more samples than bytes")
        return np.full(n, fixed, np.int64) if fixed else _table(data, box, ">u4", skip=4)[:, 0]
    box = stbl.one(b"stz2")
    bits = data[box.a + 7]
    if bits == 4:
        n = struct.unpack_from(">I", data, box.a + 8)[0]
        if box.a + 12 + (n + 1) // 2 > box.z:
            raise ValueError("a table is longer than its box")
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, box.a + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
    if bits not in (8, 16):
        raise ValueError("sizes of an unknown width")
    return _table(data, box, ">u1" if bits == 8 else ">u2", skip=4)[:, 0]


def _timing(data: memoryview, box: Box) -> tuple[int, int]:
    """Timescale and duration of mdhd; the greatest duration means that none is known."""
    wide = data[box.a] == 1
    scale, length = struct.unpack_from(">IQ", data, box.a + 20) if wide else struct.unpack_from(">II", data, box.a + 12)
    return scale, 0 if length == (1 << (64 if wide else 32)) - 1 else length


def sample_places(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Byte offset of each sample. runs: rows of (first chunk from 1, samples in a chunk, description)."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise ValueError("the chunk table doesn't fit")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per.sum() != len(sizes):
        raise ValueError("the tables count different samples")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    lead = before[np.minimum(np.cumsum(per) - per, len(sizes) - 1)]
    return chunks[chunk] + before - lead[chunk]


@dataclass
class Samples:
    offset: np.ndarray
    size: np.ndarray
    start: np.ndarray
    sync: np.ndarray
    end: int  # where the next sample would start in time


def _from_tables(data: memoryview, stbl: Box) -> Samples:
    sizes = _sizes(data, stbl)
    n = len(sizes)
    chunks = _table(data, stbl.one(b"co64"), ">u8")[:, 0] if stbl.all(b"co64") else _table(data, stbl.one(b"stco"), ">u4")[:, 0]
    offset = sample_places(sizes, chunks, _table(data, stbl.one(b"stsc"), ">u4", 3))
    times = _table(data, stbl.one(b"stts"), ">u4", 2)
    if times[:, 0].sum() != n:
        raise ValueError("the time table counts other samples")
    step = np.repeat(times[:, 1], times[:, 0])
    sync = np.ones(n, bool)
    if stbl.all(b"stss"):
        at = _table(data, stbl.one(b"stss"), ">u4")[:, 0]
        if len(at) and (at.min() < 1 or at.max() > n):
            raise ValueError("a keyframe is no sample")
        sync = np.zeros(n, bool)
        sync[at - 1] = True
    return Samples(offset, sizes, np.cumsum(step) - step, sync, int(step.sum()))


NOT_SYNC = 0x10000


def _fields(data: memoryview, box: Box, at: int, flags: int, names: list[tuple[int, str]]) -> tuple[dict[str, int], int]:
    """The optional fields that the flags of a box announce, and where they end."""
    out = {}
    for flag, kind in names:
        if flags & flag:
            if at + struct.calcsize(kind) > box.z:
                raise ValueError("a box is cut off")
            out[flag] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return out, at


def _from_fragments(data: memoryview, number: int, moov: Box, moofs: list[Box], begin: int) -> list[Samples]:
    """The samples of a track in each run of each fragment; begin: where the tables end in time."""
    common = (0, 0, 0)
    for trex in [x for mvex in moov.all(b"mvex") for x in mvex.all(b"trex")]:
        if struct.unpack_from(">I", data, trex.a + 4)[0] == number:
            common = struct.unpack_from(">III", data, trex.a + 12)
    out, time = [], begin
    for moof in moofs:
        behind = moof.start  # where the data of the track fragment before ends
        for traf in moof.all(b"traf"):
            tfhd = traf.one(b"tfhd")
            flags, own = struct.unpack_from(">II", data, tfhd.a)
            got, _ = _fields(data, tfhd, tfhd.a + 8, flags, [(1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")])
            base = got.get(1, moof.start if flags & 0x20000 else behind)
            duration, size, kind = (got.get(f, c) for f, c in zip((8, 16, 32), common, strict=True))
            if own == number and traf.all(b"tfdt"):
                tfdt = traf.one(b"tfdt")
                time = struct.unpack_from(">Q" if data[tfdt.a] == 1 else ">I", data, tfdt.a + 4)[0]
            at = base
            for trun in traf.all(b"trun"):
                flags, n = struct.unpack_from(">II", data, trun.a)
                head, first = _fields(data, trun, trun.a + 8, flags, [(1, ">i"), (4, ">I")])
                present = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
                if first + 4 * n * len(present) > trun.z or n > len(data):
                    raise ValueError("a run is longer than its box")
                rows = np.frombuffer(data, ">u4", n * len(present), first).reshape(n, len(present)).astype(np.int64)
                col = lambda f, default, rows=rows, present=present, n=n: rows[:, present.index(f)] if f in present else np.full(n, default, np.int64)
                step, sizes, kinds = col(0x100, duration), col(0x200, size), col(0x400, kind)
                if 4 in head and n:
                    kinds = kinds.copy()
                    kinds[0] = head[4]
                at = base + head[1] if 1 in head else at
                if own == number:
                    out.append(Samples(at + np.cumsum(sizes) - sizes, sizes, time + np.cumsum(step) - step, kinds & NOT_SYNC == 0, time + int(step.sum())))
                    time += int(step.sum())
                at += int(sizes.sum())
            behind = at
    return out


def _codec(data: memoryview, stsd: Box) -> str:
    """The format of the first sample entry; behind an encryption the one that it hides."""
    at = stsd.a + 8
    size, kind = struct.unpack_from(">I4s", data, at)
    skip = {b"encv": 86, b"enca": 36}.get(kind)
    if skip:
        for x in boxes(data, at + skip, min(at + size, stsd.z), 1):
            for y in boxes(data, x.a, x.z, 1) if x.kind == b"sinf" else ():
                kind = bytes(data[y.a : y.a + 4]) if y.kind == b"frma" else kind
    return kind.decode("latin-1")


def track(data: memoryview, trak: Box, moov: Box, moofs: list[Box]) -> dict:
    out: dict = {"keyframes": [], "error": None}
    try:
        tkhd = trak.all(b"tkhd")
        if tkhd:
            out["track"] = struct.unpack_from(">I", data, tkhd[0].a + (20 if data[tkhd[0].a] == 1 else 12))[0]
        media = trak.one(b"mdia")
        if media.all(b"hdlr"):
            out["kind"] = bytes(data[media.one(b"hdlr").a + 8 :][:4]).decode("latin-1")
        scale, length = _timing(data, media.one(b"mdhd"))
        out["duration"] = length / scale if scale else None
        stbl = media.one(b"minf", b"stbl")
        out["codec"] = _codec(data, stbl.one(b"stsd"))
        parts = [_from_tables(data, stbl)]
        if moofs and "track" in out:
            parts += _from_fragments(data, out["track"], moov, moofs, parts[0].end)
        offset, size, start, sync = (np.concatenate([getattr(p, k) for p in parts]) for k in ("offset", "size", "start", "sync"))
        out["samples"] = len(size)
        if scale:
            out["duration"] = max(length, max(p.end for p in parts)) / scale
        if len(size) and (offset.min() < 0 or (offset + size).max() > len(data)):
            raise ValueError("a sample lies beyond the end")
        i = np.flatnonzero(sync)
        out["keyframes"] = [{"sample": s, "offset": o, "size": z, "seconds": t} for s, o, z, t in zip((i + 1).tolist(), offset[i].tolist(), size[i].tolist(), (start[i] / (scale or 1)).tolist(), strict=True)]
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def inspect(payload: bytes) -> list[dict]:
    """A row for each track."""
    data = memoryview(payload)
    try:
        top = Box(b"", 0, 0, len(data), list(boxes(data, 0, len(data))))
        moov, moofs = top.one(b"moov"), top.all(b"moof")
        return [{"track": i, **track(data, t, moov, moofs)} for i, t in enumerate(moov.all(b"trak"), 1)]
    except (ValueError, struct.error) as e:
        return [{"error": f"{type(e).__name__}: {e}"}]


def media_columns(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = [(d, *(t.get(c) for c in _NAMES[1:])) for d, p in zip(b.column(0)[i : i + 256].to_pylist(), b.column(1)[i : i + 256].to_pylist(), strict=True) if p for t in inspect(p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_NAMES), _TYPES, strict=True)], _NAMES)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{payload_col}`").alias("payload")).mapInArrow(each, SCHEMA)


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


CODECS = [b"avc1", b"hvc1", b"av01", b"mp4a", b"tx3g"]


def container(doc_id: int, text: str) -> bytes:
    """A container whose samples are the lines of a text; every fourth line is a keyframe, sound has keyframes only.

    One in four is fragmented: its movie box has no samples, and runs of up to eight lines follow.
    """
    samples = [s.encode() + b"\n" for s in text.split("\n")]
    codec = CODECS[doc_id % len(CODECS)]
    parts = doc_id % 4 == 3
    sound, n, per = codec == b"mp4a", 0 if parts else len(samples), 3
    sizes = [len(s) for s in samples[:n]]
    full = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[::per].tolist() if n else []

    def moov(base: int) -> bytes:
        wide = doc_id % 7 == 0
        last = n % per
        runs = [(1, per)] * (n >= per) + [(n // per + 1, last)] * bool(last)
        stbl = [
            box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(6), struct.pack(">H", 1))),
            box(b"stts", struct.pack(">II", 0, bool(n)), struct.pack(">II", n, 40) if n else b""),
            box(b"stsc", struct.pack(">II", 0, len(runs)), *[struct.pack(">III", a, k, 1) for a, k in runs]),
            box(b"stsz", struct.pack(">III", 0, 0, n), np.array(sizes, ">u4").tobytes()),
            box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(starts)), np.array([base + s for s in starts], ">u8" if wide else ">u4").tobytes()),
        ]
        if not sound and not parts:
            sync = np.arange(1, n + 1, 4)
            stbl.append(box(b"stss", struct.pack(">II", 0, len(sync)), sync.astype(">u4").tobytes()))
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 1000, 40 * n, 0, 0)), box(b"hdlr", struct.pack(">II", 0, 0), b"soun" if sound else b"text" if codec == b"tx3g" else b"vide", bytes(13)), box(b"minf", box(b"stbl", *stbl)))
        more = box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 40, 0, 0 if sound else NOT_SYNC))) if parts else b""
        return box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 40 * n), bytes(80)), box(b"trak", box(b"tkhd", struct.pack(">IIIIII", 0, 0, 0, 1, 0, 40 * n), bytes(60)), mdia), more)

    if not parts:
        return full + moov(len(full) + len(moov(0)) + 8) + box(b"mdat", b"".join(samples))
    out = [full, moov(0)]
    for k in range(0, len(samples), 8):
        some = samples[k : k + 8]
        rows = b"".join(struct.pack(">II", len(s), 0 if sound or i % 4 == 0 else NOT_SYNC) for i, s in enumerate(some, k))
        head = lambda at, rows=rows, some=some, k=k: box(b"moof", box(b"mfhd", struct.pack(">II", 0, k // 8 + 1)), box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"tfdt", struct.pack(">II", 0, 40 * k)), box(b"trun", struct.pack(">IIi", 0x601, len(some), at), rows)))
        out += [head(len(head(0)) + 8), box(b"mdat", *some)]
    return b"".join(out)


def containers(docs: DataFrame) -> DataFrame:
    """doc_id, payload: the texts as containers; there is no table of media, so this is what the query reads."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in K.slices(b.column(1)):
                made = [container(d, t) for d, t in zip(b.column(0).slice(a, z - a).to_pylist(), b.column(1).slice(a, z - a).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(made, pa.binary())], ["doc_id", "payload"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, payload binary")
