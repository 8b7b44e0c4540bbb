"""Vectorised tokens over Arrow string columns.

A batch of texts is one byte buffer plus offsets.  Words, their 64-bit hashes and
the hashes of word n-grams come from prefix sums over that buffer, so the cost is
a few array passes per byte and no Python object is made per word.

Hashes are polynomials modulo 2**64 over random byte values, then mixed.  Two
different words (or n-grams) share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text handled at once; arrays over them stay near the CPU caches.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the license and decontamination words: all ASCII but digits and lower-case letters.
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    size = max(SLICE_BYTES + 65536, 1 << max(1, n - 1).bit_length())
    if size not in _pow:
        _pow.clear()
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _pow[size] = tuple(out)
    return _pow[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Words:
    """Words of a batch: byte spans, hashes and the document each belongs to."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, lower: bool, separators: np.ndarray):
        n = len(buf)
        self.raw = buf
        self.buf = buf = _LOWER[buf] if lower else buf
        self.bounds = bounds
        inside = ~separators[buf] if n else np.zeros(0, bool)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        gap = np.ones(n + 1, bool)
        gap[1:] = ~inside
        self.starts = np.flatnonzero(inside & (gap[:-1] | first[:-1]))
        gap[:-1] = ~inside
        gap[-1] = True
        self.ends = np.flatnonzero(inside & (gap[1:] | first[1:])) + 1
        #: Offsets of each document's words.
        self.at = np.searchsorted(self.starts, bounds)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        """Hash of each word; the arrays over bytes cover a part of the words at a time."""
        if self._hash is None:
            out = np.empty(len(self), U64)
            k = 0
            while k < len(self):
                m = max(k + 1, int(np.searchsorted(self.ends, self.starts[k] + SLICE_BYTES, "right")))
                lo, hi = int(self.starts[k]), int(self.ends[m - 1])
                up, down = _powers(hi - lo + 1)
                c = np.zeros(hi - lo + 1, U64)
                np.cumsum(_BYTE[self.buf[lo:hi]] * up[: hi - lo], out=c[1:])
                s = self.starts[k:m] - lo
                out[k:m] = (c[self.ends[k:m] - lo] - c[s]) * down[s]
                k = m
            self._hash = mix(out)
        return self._hash


def words(texts: pa.Array, lower: bool = True, separators: np.ndarray = _SPACE) -> Words:
    """Words of each text; a null text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Words(buf, off - off[0], lower, separators)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; the caller masks those that cross documents."""
    out = np.empty(max(0, len(h) - n + 1), U64)
    for a in range(0, len(out), SLICE_BYTES):
        b = min(len(out), a + SLICE_BYTES)
        part = h[a : b + n - 1]
        up, down = _powers(len(part) + 1)
        c = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=c[1:])
        out[a:b] = mix((c[n:] - c[:-n]) * down[: b - a] + U64(n))
    return out


def sequence_ids(w: Words) -> np.ndarray:
    """Hash of each document's whole word sequence."""
    total = np.zeros(len(w.count), U64)
    for a in range(0, len(w), SLICE_BYTES):
        b = min(len(w), a + SLICE_BYTES)
        up, down = _powers(b - a + 1)
        c = np.zeros(b - a + 1, U64)
        np.cumsum(w.hash[a:b] * up[: b - a], out=c[1:])
        d = np.arange(w.doc[a], w.doc[b - 1] + 1)
        lo, hi = np.maximum(w.at[d], a) - a, np.minimum(w.at[d + 1], b) - a
        part = (c[hi] - c[lo]) * down[lo]
        # a document that began in an earlier part: its words here stand behind those
        part[:1] *= U64(pow(_BASE, max(0, a - int(w.at[d[0]])), 2**64))
        total[d] += part
    return mix(total + mix(w.count.astype(U64) + U64(17))).view(np.int64)


def doc_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-gram inside one document."""
    g = grams(w.hash, n)
    inside = w.doc[: len(g)] == w.doc[n - 1 :] if len(g) else np.zeros(0, bool)
    return g[inside], w.doc[: len(g)][inside]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: Numbers that a task remembers so as not to send copies twice.
KEEP = 1 << 18


class Remembered:
    """Numbers met before; forgets all when there are more than ``KEEP``."""

    def __init__(self):
        self.seen: set[int] = set()

    def fresh(self, numbers: np.ndarray) -> np.ndarray:
        """Which numbers are met for the first time."""
        if len(self.seen) > KEEP:
            self.seen.clear()
        seen = self.seen
        return np.array([not (x in seen or seen.add(x)) for x in numbers.tolist()], bool)


def runs(mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of marked words that lies in one document."""
    at = np.flatnonzero(mark)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])) if len(at) else np.zeros(0, bool)
    return at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at


def crc_mod(ids: pa.Array, m: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo m; -1 for a null id."""
    import zlib

    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) % m for x in ids.to_pylist()], np.int64)


#: Rows of a batch of whole documents that goes to Python.
BATCH_ROWS = 256
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Whole documents can be long, so a batch that goes to Python holds few of them.

    The bound stays in the session, as frames that operators return run later; it is only
    ever lowered, so it does not matter which operator was called last.
    """
    have = int(spark.conf.get(_ROWS))
    if not 0 < have <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Larger batches for the short rows of frames that are written inside the block."""
    have = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, have)


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, and the driver what such plans took."""
    trim()
    spark.sparkContext._jvm.System.gc()


def releasing(f):
    """``f`` over batches, giving memory back to the system when a task ends: workers live on, and what one task freed would add to the next one's."""

    def g(batches):
        try:
            yield from f(batches)
        finally:
            _pow.clear()
            trim()

    return g


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder; only where it is unset, as in
    tests, a folder under the warehouse is used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: Keys that can each hold more than 1 / HOT_KEYS of all rows; there cannot be more of them.
HOT_KEYS = 1000


def joined_by(rows: DataFrame, per_key: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``per_key`` on ``key``; ``count`` says how many rows have a key.

    A key with more than 1 / ``HOT_KEYS`` of all rows would be one task of a shuffle: such
    keys, at most ``HOT_KEYS``, are broadcast, and their rows stay where they are.
    """
    from pyspark.sql import functions as F

    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = per_key.where(F.col(count) * HOT_KEYS > total).drop(count).toArrow()
    rest = per_key.drop(count)
    if not len(hot):
        return rows.join(rest, key)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot))
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return rows.join(few, key).unionByName(cold)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def drop_written(df: DataFrame) -> None:
    """Remove the files of a frame that ``written`` returned."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, max_bytes: int) -> tuple[list[pa.Array], list[int]]:
    """Texts of at most ``sample`` rows and ``max_bytes`` of each class 0 and 1, and the number of labelled rows of each class.

    ``docs``: doc_id, text; ``labels``: doc_id and ``label``, one row an id.  Ids are
    matched and picked in order of a hash of the id before any text is read; then a
    broadcast of at most 2 * ``sample`` ids fetches their texts, however long each is.  A
    class takes them in that order while they fit into what is left of ``max_bytes``.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    there = labels.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.col(label) == 1).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in there.groupBy("y").count().collect()}
    picks = [there.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = [(r["doc_id"], r["y"], i) for p in picks for i, r in enumerate(p.collect())]
    ids = F.broadcast(spark.createDataFrame(rows, "doc_id bigint, y int, place int"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    found = written(docs.join(ids, "doc_id").select("y", "place", size.alias("size"), F.xxhash64("text").alias("own"), "text"), "labelled")
    out = []
    for k in (0, 1):
        own = found.where(F.col("y") == k)
        # one row a label, the first of rows that share an id
        sizes = own.groupBy("place").agg(F.min(F.struct("size", "own")).alias("t")).select("place", "t.*").orderBy("place").collect()
        left, taken = max_bytes, []
        for r in sizes:
            if r["size"] <= left:
                left -= r["size"]
                taken.append((r["place"], r["own"]))
        wanted = F.broadcast(spark.createDataFrame(taken, "place int, own bigint"))
        t = own.join(wanted, ["place", "own"]).groupBy("place").agg(F.first("text").alias("text")).toArrow().sort_by([("place", "ascending")])["text"]
        out.append(pa.concat_arrays([c.cast(pa.large_string()) for c in t.chunks] or [pa.array([], pa.large_string())]))
    drop_written(found)
    return out, [counts.get(k, 0) for k in (0, 1)]
