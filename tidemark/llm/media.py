"""ISO base media containers: write 8-bit sample tracks, walk boxes, decode sample tables.

``wrap`` stores bytes losslessly as a raw 8-bit sample track.  ``inspect`` reads
any container of nested boxes: it decodes the sample tables and movie fragments of
every track and returns codec, duration and the byte range of each keyframe, without
touching the payload.  ``read_samples`` returns a track's stored bytes by its sample tables.

Defined results: a null blob counts as empty and has no tracks; a truncated or
malformed box ends the walk of its parent, what was read before it is kept and
``error`` says what was wrong; extra and unknown boxes are skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

#: Bytes of one stored frame; each frame holds that many 8-bit samples.
FRAME = 64
#: Every such frame is marked as a sync sample.
KEY_EVERY = 16
#: Frames in one chunk.
CHUNK_FRAMES = 256
TIMESCALE = 8000
#: Boxes that hold boxes (fixed values of the container format).
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex", b"udta"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A container with one raw 8-bit track; its length must be a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    if not frames or frames * FRAME != len(payload):
        raise ValueError(f"payload must be a positive multiple of {FRAME} bytes")
    chunks, rest = divmod(frames, CHUNK_FRAMES)
    runs = ([(1, CHUNK_FRAMES, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    ticks = len(payload)
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(offsets: np.ndarray, wide: bool) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30), bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 65536, 0x100), struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30), bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    wide = len(payload) > 2**31
    at = np.arange(0, len(payload), FRAME * CHUNK_FRAMES, dtype=np.int64)
    head = len(ftyp) + len(moov(at, wide)) + (16 if len(payload) + 8 >= 2**32 else 8)
    return b"".join((ftyp, moov(at + head, wide), box(b"mdat", payload)))


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None

    @property
    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each sync sample; without a sync table every sample is one."""
        if self.sync is None:
            return self.offsets, self.sizes
        i = self.sync[(self.sync >= 1) & (self.sync <= len(self.offsets))] - 1
        return self.offsets[i], self.sizes[i]


def walk(data: memoryview, lo: int, hi: int, path: tuple = ()):
    """Yield (path, start, end) of each box; raise ValueError at a malformed one."""
    while lo < hi:
        if hi - lo < 8:
            raise ValueError(f"{hi - lo} stray bytes at {lo}")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if hi - lo < 16:
                raise ValueError(f"truncated box at {lo}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = hi - lo
        if size < body - lo or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} does not fit its parent")
        yield (*path, kind), body, lo + size
        if kind in CONTAINERS:
            yield from walk(data, body, lo + size, (*path, kind))
        lo += size


def _table(data: memoryview, at: int, end: int, n: int, dtype: str, cols: int = 1) -> np.ndarray:
    width = np.dtype(dtype).itemsize * cols
    if at + n * width > end:
        raise ValueError(f"table of {n} entries at {at} does not fit its box")
    out = np.frombuffer(data, dtype, n * cols, at).astype(np.int64)
    return out.reshape(n, cols) if cols > 1 else out


def _decode(boxes: dict[bytes, tuple[int, int]], data: memoryview) -> Track:
    t = Track()
    if b"mdhd" in boxes:
        a, _ = boxes[b"mdhd"]
        t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    if b"hdlr" in boxes:
        a, _ = boxes[b"hdlr"]
        t.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    if b"stsd" in boxes:
        a, e = boxes[b"stsd"]
        if e - a >= 16:
            t.codec = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
    if b"stsz" in boxes:
        a, e = boxes[b"stsz"]
        size, n = struct.unpack_from(">II", data, a + 4)
        if size and n > len(data):
            raise ValueError("more samples than bytes")
        t.sizes = np.full(n, size, np.int64) if size else _table(data, a + 12, e, n, ">u4")
    elif b"stz2" in boxes:
        a, e = boxes[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16):
            raise ValueError(f"sample sizes of {bits} bits")
        if bits == 4:
            pairs = _table(data, a + 12, e, -(-n // 2), ">u1")
            t.sizes = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n]
        else:
            t.sizes = _table(data, a + 12, e, n, f">u{bits // 8}")
    if b"stss" in boxes:
        a, e = boxes[b"stss"]
        t.sync = _table(data, a + 8, e, struct.unpack_from(">I", data, a + 4)[0], ">u4")
    chunk = next((k for k in (b"stco", b"co64") if k in boxes), None)
    if chunk and b"stsc" in boxes and len(t.sizes):
        a, e = boxes[chunk]
        chunks = _table(data, a + 8, e, struct.unpack_from(">I", data, a + 4)[0], ">u4" if chunk == b"stco" else ">u8")
        a, e = boxes[b"stsc"]
        runs = _table(data, a + 8, e, struct.unpack_from(">I", data, a + 4)[0], ">u4", 3)
        if len(runs) and len(chunks):
            length = np.diff(np.append(runs[:, 0], len(chunks) + 1))
            if (length < 0).any() or runs[0, 0] != 1 or (runs[:, 1] * length).sum() < len(t.sizes):
                raise ValueError("chunk runs do not cover the samples")
            per = np.repeat(runs[:, 1], length)
            first = np.cumsum(per) - per
            of = np.repeat(np.arange(len(per)), per)[: len(t.sizes)]
            before = np.cumsum(t.sizes) - t.sizes
            t.offsets = chunks[of] + before - before[np.minimum(first[of], len(t.sizes) - 1)]
    return t


def _track_id(boxes: dict[bytes, tuple[int, int]], data: memoryview) -> int:
    if b"tkhd" not in boxes:
        return 0
    a, _ = boxes[b"tkhd"]
    return struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]


def _fragment(t: Track, trex: tuple, moof: int, follow: int, traf: list[tuple[bytes, int, int]], data: memoryview) -> int:
    """Add the samples of one track fragment; returns where its data ends.

    ``trex``: default duration, size and flags; ``follow``: where the data of the fragment before it ends.
    """
    _, a, e = next(x for x in traf if x[0] == b"tfhd")
    flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
    at, base = a + 8, moof if flags & 0x20000 else follow
    if flags & 1:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 if flags & 2 else 0
    default = list(trex)
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (default[k],) = struct.unpack_from(">I", data, at)
            at += 4
    if at > e:
        raise ValueError(f"fragment header at {a} does not fit its box")
    for kind, a, e in traf:
        if kind != b"trun":
            continue
        flags, n = struct.unpack_from(">II", data, a)
        at, flags, start = a + 8, flags & 0xFFFFFF, follow
        if flags & 1:
            start = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        elif not any(x[0] == b"trun" and x[1] < a for x in traf):
            start = base
        first = None
        if flags & 4:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if not given and n > len(data):
            raise ValueError("more samples than bytes")
        rows = _table(data, at, e, n, ">u4", len(given)).reshape(n, len(given)) if given else None
        duration, size, mark = (rows[:, given.index(bit)] if flags & bit else np.full(n, default[k], np.int64) for k, bit in enumerate((0x100, 0x200, 0x400)))
        if first is not None and n:
            mark = np.append(first, mark[1:])
        had = len(t.sizes)
        if t.sync is None:
            t.sync = np.arange(1, had + 1)
        t.sync = np.append(t.sync, had + 1 + np.flatnonzero(mark & 0x10000 == 0))
        t.offsets = np.append(t.offsets, start + np.cumsum(size) - size)
        t.sizes = np.append(t.sizes, size)
        t.duration += int(duration.sum())
        follow = start + int(size.sum())
    return follow


def inspect(blob: bytes | None) -> tuple[list[Track], str]:
    """Tracks of a container, and the first fault met ('' if none)."""
    data, tracks, error = memoryview(blob or b""), [], ""
    open_: dict[bytes, tuple[int, int]] | None = None
    found: list[dict] = []
    defaults: list[tuple[int, int]] = []
    moofs: list[tuple[int, list]] = []
    try:
        for path, a, e in walk(data, 0, len(data)):
            if path[-1] == b"trak":
                found.append(open_ := {})
            elif open_ is not None and b"trak" in path:
                open_.setdefault(path[-1], (a, e))
            elif path[-1] == b"trex":
                defaults.append((a, e))
            elif path == (b"moof",):
                moofs.append((a - (16 if data[a - 12 : a - 8] == b"moof" else 8), []))
            elif path == (b"moof", b"traf"):
                moofs[-1][1].append([])
            elif path[:2] == (b"moof", b"traf") and path[-1] in (b"tfhd", b"trun"):
                moofs[-1][1][-1].append((path[-1], a, e))
    except ValueError as x:
        error = str(x)
    for boxes in found:
        try:
            tracks.append(_decode(boxes, data))
        except (ValueError, struct.error, IndexError) as x:
            error = error or str(x)
            tracks.append(Track())
    if not moofs:
        return tracks, error
    try:
        ids = {_track_id(b, data): t for b, t in zip(found, tracks, strict=True)}
        trex = {x[0]: x[2:] for x in (struct.unpack_from(">5I", data, a + 4) for a, _ in defaults)}
        for t in tracks:
            # all ones: not known
            t.duration = 0 if t.duration in (2**32 - 1, 2**64 - 1) else t.duration
        for start, trafs in moofs:
            follow = start
            for traf in trafs:
                if not any(k == b"tfhd" for k, *_ in traf):
                    raise ValueError(f"fragment at {start} has no header")
                own = struct.unpack_from(">I", data, next(a for k, a, _ in traf if k == b"tfhd") + 4)[0]
                if own not in ids:
                    raise ValueError(f"fragment of unknown track {own}")
                follow = _fragment(ids[own], trex.get(own, (0, 0, 0)), start, follow, traf, data)
    except (ValueError, struct.error, IndexError) as x:
        error = error or str(x)
    return tracks, error


def read_samples(blob: bytes, track: Track) -> bytes:
    """The bytes of all samples in decoding order; neighbouring samples are read together."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    lo, hi = track.offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]
    return b"".join(blob[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def pad(data: bytes) -> bytes:
    """Append bytes 0 up to a positive multiple of FRAME."""
    return data + bytes((-len(data)) % FRAME or (0 if data else FRAME))


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _ranges(tracks: list[Track | None]) -> pa.Array:
    """Keyframe ranges of one track a row."""
    pairs = [t.keyframes if t else (np.zeros(0, np.int64),) * 2 for t in tracks]
    off = np.cumsum([0, *(len(a) for a, _ in pairs)]).astype(np.int32)
    at, size = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(at), pa.array(size)], ["start", "length"]))


def media_columns(df: DataFrame, blob: str, keep: list[str]) -> DataFrame:
    """All tracks of each container: handler, codec, timescale, duration, samples and keyframe byte ranges.

    One row per input row with the columns ``keep``; the first track has columns of its
    own beside ``tracks``; ``error`` is '' for a sound file.
    """
    TRACK = "struct<handler:string,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,length:bigint>>>"

    def all_tracks(rows: list[list[Track]]) -> pa.Array:
        flat = [t for r in rows for t in r]
        at = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
        text = [pa.array([getattr(t, k) for t in flat], pa.string()) for k in ("handler", "codec")]
        number = [pa.array([getattr(t, k) for t in flat], pa.int64()) for k in ("timescale", "duration")]
        fields = [*text, *number, pa.array([len(t.sizes) for t in flat], pa.int64()), _ranges(flat)]
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, ["handler", "codec", "timescale", "duration", "n_samples", "keyframes"]))

    def of(batches):
        for b in batches:
            rows = [inspect(x) for x in b.column("_blob").to_pylist()]
            first = [t[0] if t else None for t, _ in rows]
            cols = [b.column(k) for k in keep] + [
                pa.array([t.codec if t else None for t in first], pa.string()),
                pa.array([t.timescale if t else None for t in first], pa.int64()),
                pa.array([t.duration if t else None for t in first], pa.int64()),
                pa.array([len(t.sizes) if t else 0 for t in first], pa.int64()),
                _ranges(first),
                pa.array([e for _, e in rows], pa.string()),
                all_tracks([t for t, _ in rows]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "codec", "timescale", "duration", "n_samples", "keyframes", "error", "tracks"])

    textkit.bounded_batches(df.sparkSession)
    src = df.select(*keep, df[blob].cast("binary").alias("_blob"))
    types = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(textkit.releasing(of), f"{types}, codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start:bigint,length:bigint>>, error string, tracks array<{TRACK}>")


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a container, read it back, and describe both.

    The payload is the UTF-8 text (null: empty) with bytes 0 appended up to a
    positive multiple of 64.  Equal texts give equal values.  One row per input
    row, repeated ids and null ids included.
    """

    def of(batches):
        for b in batches:
            rows = []
            for x in b.column("text").cast(pa.binary()).to_pylist():
                x = x or b""
                blob = wrap(pad(x))
                (track,), error = inspect(blob)
                back = read_samples(blob, track)
                at, size = track.keyframes
                feature = f"codec={track.codec};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(at)};ranges={zlib.crc32(np.stack([at, size]).astype('>i8').tobytes()):08x}"
                if error:
                    raise ValueError(error)
                rows.append((len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, track))
            c = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [b.column("doc_id"), *(pa.array(v, t) for v, t in zip(c, types, strict=False)), pa.array([t.codec for t in c[7]], pa.string()), pa.array([t.duration / t.timescale for t in c[7]], pa.float64()), _ranges(list(c[7]))]
            yield pa.RecordBatch.from_arrays(out, names=NAMES)

    textkit.bounded_batches(docs.sparkSession)
    NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return src.mapInArrow(textkit.releasing(of), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<start:bigint,length:bigint>>")
