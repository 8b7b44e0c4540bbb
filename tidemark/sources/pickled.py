"""Pickle source: frames of a big-endian length and ``[(key, (ts, value)), ...]``.

Only lists, tuples, texts and numbers can be unpickled; anything else ends the frame.
"""

from __future__ import annotations

import io
import pickle
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.sources import batches as bounds


class _Plain(pickle.Unpickler):
    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid):
        raise pickle.UnpicklingError("persistent ids are not allowed")


def frames(data: bytes):
    """Payloads of all whole frames."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            return
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def points(payload: bytes) -> list[tuple[str, int, float]]:
    """Well-formed tuples of one payload; others are skipped."""
    try:
        rows = _Plain(io.BytesIO(payload), encoding="utf-8").load()
    except Exception:  # any malformed payload is an empty one
        return []
    out = []
    for r in rows if isinstance(rows, (list, tuple)) else []:
        try:
            key, (ts, value) = r
            if isinstance(key, bytes):
                key = key.decode()
            if isinstance(key, str):
                out.append((key, int(ts), float(value)))
        except (TypeError, ValueError, UnicodeDecodeError, OverflowError):
            continue
    return out


def parse_pickled(blobs: DataFrame, column: str = "content") -> DataFrame:
    """key, ts, value of every point in binary ``column`` (for example of ``binaryFile``)."""

    def rows(found):
        k, t, v = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(t, pa.int64()), pa.array(v, pa.float64())], names=["key", "ts", "value"])

    def of(batches):
        for b in batches:
            found = []
            for x in b.column(0):
                for f in frames(x.as_py() or b""):
                    found += points(f)
                    if len(found) >= bounds.POINTS:
                        yield rows(found)
                        found = []
            yield rows(found)

    bounds.bounded(blobs.sparkSession)
    return blobs.select(column).mapInArrow(of, "key string, ts bigint, value double")


def encode(rows: list[tuple[str, int, float]]) -> bytes:
    """One frame."""
    body = pickle.dumps([(k, (t, v)) for k, t, v in rows], protocol=2)
    return struct.pack(">I", len(body)) + body
