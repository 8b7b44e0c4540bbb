"""Fixed-size ring files, one a series: header, archive table, rings of (u32 time, f64 value).

    header : u32 method, u32 longest retention, f32 xff, u32 archives     (big-endian)
    archive: u32 offset, u32 seconds per point, u32 points
    slot   : u32 time (0: empty), f64 value
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeparse
from tidemark.sources import batches as bounds

HEADER, ARCHIVE = struct.Struct(">IIfI"), struct.Struct(">III")
SLOT = np.dtype([("ts", ">u4"), ("value", ">f8")])


class FormatError(ValueError):
    """A ring file is malformed."""


def decode(data: bytes) -> tuple[dict, list[np.ndarray]]:
    """Metadata and the slots of each archive as stored."""
    if len(data) < HEADER.size:
        raise FormatError("truncated header")
    method, retention, xff, count = HEADER.unpack_from(data)
    if method not in timeparse.METHODS:
        raise FormatError(f"unknown aggregation method {method}")
    if not 0 <= xff <= 1:
        raise FormatError("xff out of range")
    if HEADER.size + count * ARCHIVE.size > len(data):
        raise FormatError("truncated archive table")
    table = [ARCHIVE.unpack_from(data, HEADER.size + k * ARCHIVE.size) for k in range(count)]
    try:
        timeparse.check_archives([(step, n) for _, step, n in table])
    except ValueError as e:
        raise FormatError(str(e)) from e
    rings = []
    for at, _, n in table:
        if at + n * SLOT.itemsize > len(data):
            raise FormatError("truncated ring")
        rings.append(np.frombuffer(data, SLOT, n, at))
    return {"agg": method, "xff": float(xff), "archives": [(step, n) for _, step, n in table]}, rings


def encode(archives: list[tuple[int, int]], agg: int, xff: float, points: list[list[tuple[int, float]]]) -> bytes:
    """A file whose rings hold ``points`` of each archive; the base of a ring is its first point's slot."""
    timeparse.check_archives(archives)
    at = HEADER.size + ARCHIVE.size * len(archives)
    out = [HEADER.pack(agg, max(s * n for s, n in archives), timeparse.xff(xff), len(archives))]
    for step, n in archives:
        out.append(ARCHIVE.pack(at, step, n))
        at += n * SLOT.itemsize
    for (step, n), own in zip(archives, points, strict=True):
        ring = np.zeros(n, SLOT)
        base = own[0][0] // step if own else 0
        for ts, value in own:
            ring[(ts // step - base) % n] = (ts - ts % step, value)
        out.append(ring.tobytes())
    return b"".join(out)


def scan(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """Catalogue and points of all ``*.wsp`` files below ``path``; a file's place below ``root`` is its key.

    Empty slots and NaN are left out, as in a full read.  Malformed files have no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wsp").load(path)
    below = (root or path).rstrip("/") + "/"
    key = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", below, 2), -1), r"\.wsp$", ""), "/", ".")
    return _frames(files.select(key.alias("key"), "content"))


def _rows(held: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Points of rings given as (key, tier, step, slots)."""
    key, tier, step, slots = zip(*held, strict=True)
    count = np.array([len(s) for s in slots])
    own = np.concatenate(slots)
    cols = [pa.array(key, pa.string()).take(pa.array(np.repeat(np.arange(len(key)), count))), *(pa.array(np.repeat(np.array(x, np.int32), count)) for x in (tier, step))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(own["ts"].astype(np.int64)), pa.array(own["value"].astype(np.float64))], names=["key", "tier", "step", "ts", "value"])


def _frames(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue and points of files (key, content)."""

    def catalog(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column("key").to_pylist(), b.column("content"), strict=True):
                try:
                    m, _ = decode(data.as_py())
                except FormatError:
                    continue
                rows.append({"key": k, "archives": [{"precision": s, "points": n} for s, n in m["archives"]], "xff": m["xff"], "agg": m["agg"]})
            kind = pa.struct([("precision", pa.int32()), ("points", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("archives", pa.list_(kind)), ("xff", pa.float64()), ("agg", pa.int32())]))

    def points(batches):
        for b in batches:
            held, n = [], 0
            for k, data in zip(b.column("key"), b.column("content"), strict=True):
                try:
                    m, rings = decode(data.as_py())
                except FormatError:
                    continue
                for tier, ((step, _), ring) in enumerate(zip(m["archives"], rings, strict=True)):
                    own = ring[(ring["ts"] != 0) & ~np.isnan(ring["value"])]
                    held.append((k.as_py(), tier, step, own))
                    n += len(own)
                if n >= bounds.POINTS:
                    yield _rows(held)
                    held, n = [], 0
            if held:
                yield _rows(held)

    bounds.bounded(src.sparkSession)
    return src.mapInArrow(catalog, "key string, archives array<struct<precision:int,points:int>>, xff double, agg int"), src.mapInArrow(points, "key string, tier int, step int, ts bigint, value double")


def encoded(catalog: DataFrame, points: DataFrame) -> DataFrame:
    """path (``a/b.wsp`` for key a.b) and content of each series' file; a series without points has empty rings.

    A file has a fixed size, so a row is bounded by its archives.  Of points that fall on
    one place of a ring the newest stays.
    """
    each = points.where("value IS NOT NULL").groupBy("key").agg(F.collect_list(F.struct("tier", "ts", "value")).alias("points"))
    rows = catalog.join(each, "key", "left").select("key", "archives", "xff", "agg", "points")

    def made(b):
        files = []
        for r in b.to_pylist():
            archives = [(a["precision"], a["points"]) for a in r["archives"]]
            own = [[] for _ in archives]
            for p in sorted(r["points"] or [], key=lambda p: p["ts"]):
                own[p["tier"]].append((p["ts"], p["value"]))
            files.append(encode(archives, r["agg"], r["xff"], own))
        paths = [f"{k.replace('.', '/')}.wsp" for k in b.column("key").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])

    def of(batches):
        for b in batches:
            at = 0
            # files have the size of their archives, whatever they hold
            size = [sum(SLOT.itemsize * a["points"] for a in x.as_py()) for x in b.column("archives")]
            while at < b.num_rows:
                n, total = 1, size[at]
                while at + n < b.num_rows and total + size[at + n] <= bounds.BATCH_BYTES:
                    total += size[at + n]
                    n += 1
                yield made(b.slice(at, n))
                at += n

    bounds.bounded(catalog.sparkSession)
    return rows.mapInArrow(of, "path string, content binary")


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue and points of files given as rows (path, content); malformed ones have no rows."""
    return _frames(files.select(F.regexp_replace(F.regexp_replace("path", r"\.wsp$", ""), "/", ".").alias("key"), "content"))
