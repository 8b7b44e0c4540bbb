"""Byte-level BPE encoding and decoding by a rank file.

A text is split by the tokenizer's pattern.  Each distinct piece is merged once
per task: a segment tree over its byte positions holds, for every live
position, the rank of the pair that starts there; the root is the leftmost pair of
lowest rank.  A merge rewrites two leaves (the merged position and its left
neighbour) and clears a third, each in logarithmic time.

Pieces that a batch meets for the first time are merged together: their trees are
rows of one array and advance in step.  A piece longer than LOCKSTEP uses the same
tree alone, so that a run of a million letters stays O(n log n).

The merged pair need not be listed: two neighbours merge when their joined bytes
have a rank, lowest rank first, leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

#: Longest piece, in bytes, that is merged in step with others.
LOCKSTEP = 64
#: Pieces that a worker remembers; when full, it forgets all and goes on.
CACHE = 250_000
NONE = np.int64(1 << 62)


class Vocabulary:
    """Ranks of a byte-level vocabulary, and for each pair of ids the id of the joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, joined = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.joined = keys[order], np.array(joined, np.int64)[order]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The pairs as a dictionary, for pieces that are merged alone."""
        return dict(zip(self.keys.tolist(), self.joined.tolist(), strict=True))

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the joined bytes of each pair, NONE if they have none."""
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.joined[i], NONE)


def merge_one(v: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece by its own segment tree."""
    n = len(piece)
    ids = v.byte[np.frombuffer(piece, np.uint8)].tolist()
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none, shift = int(NONE), size.bit_length()
    get = v.pairs.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, x: int) -> None:
        k = size + i
        tree[k] = x
        while k > 1:
            k >>= 1
            m = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == m:
                break
            tree[k] = m

    mask = (1 << shift) - 1
    while (top := tree[1]) != none:
        i = top & mask
        ids[i] = top >> shift
        gone = nxt[i]
        put(gone, none)
        nxt[i] = after = nxt[gone]
        ids[gone] = -1
        if after < n:
            prev[after] = i
        r = get(ids[i] << 32 | ids[after]) if after < n else None
        put(i, none if r is None else r << shift | i)
        if (p := prev[i]) >= 0:
            r = get(ids[p] << 32 | ids[i])
            put(p, none if r is None else r << shift | p)
    return [x for x in ids if x >= 0]


def merge_many(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Ids of pieces of at most ``LOCKSTEP`` bytes; their trees are rows that advance in step."""
    count = len(pieces)
    length = np.array([len(p) for p in pieces], np.int64)
    width = max(2, 1 << int(length.max() - 1).bit_length())
    levels = width.bit_length() - 1
    flat = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    ids = np.full((count, width + 1), -1, np.int64)
    ids[:, :width][np.arange(width) < length[:, None]] = flat
    tree = np.full((count, 2 * width), NONE, np.int64)
    pos = np.arange(width - 1)
    r, c = np.nonzero(pos < length[:, None] - 1)
    rank = v.pair(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(rank < NONE, rank << 8 | c, NONE)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    nxt = np.tile(np.arange(1, width + 2), (count, 1))
    prev = np.tile(np.arange(-1, width), (count, 1))

    def put(rows: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
        k = width + at
        tree[rows, k] = x
        for _ in range(levels):
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    def ranked(rows, a, b, at):
        rank = v.pair(ids[rows, a], ids[rows, b])
        return np.where(rank < NONE, rank << 8 | at, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top & 255
        ids[rows, i] = top >> 8
        gone = nxt[rows, i]
        after = nxt[rows, gone]
        nxt[rows, i] = after
        ids[rows, gone] = -1
        put(rows, gone, NONE)
        inside = after < length[rows]
        prev[rows[inside], after[inside]] = i[inside]
        x = np.full(len(rows), NONE)
        x[inside] = ranked(rows[inside], i[inside], after[inside], i[inside])
        put(rows, i, x)
        p = prev[rows, i]
        has = p >= 0
        put(rows[has], p[has], ranked(rows[has], p[has], i[has], p[has]))
        rows = rows[tree[rows, 1] < NONE]
    live = ids[:, :width] >= 0
    flat, cut = ids[:, :width][live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class Encoder:
    """Encodes texts; remembers the ids of pieces it has met."""

    def __init__(self, v: Vocabulary, pattern: str):
        import regex

        self.v, self.find = v, regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.seen) + len(pieces) > CACHE:
            self.seen.clear()
        short: dict[str, bytes] = {}
        for p in pieces:
            b = p.encode()
            if (i := self.v.ranks.get(b)) is not None:
                self.seen[p] = [i]
            elif len(b) > LOCKSTEP:
                self.seen[p] = merge_one(self.v, b)
            else:
                short[p] = b
        for lo, hi in ((1, 8), (8, 16), (16, 32), (32, LOCKSTEP)):
            group = [(p, b) for p, b in short.items() if lo < len(b) <= hi]
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                self.seen.update(zip((p for p, _ in part), merge_many(self.v, [b for _, b in part]), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.seen)
        if len(self.seen) + len(new) > CACHE:
            self.seen.clear()
            new = set(chain.from_iterable(split))
        self.learn(new)
        get = self.seen.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per task."""
    return Encoder(Vocabulary.read(path), pattern)


def _each(path: str, pattern: str, row, names: list[str]):
    def of(batches):
        enc = encoder(path, pattern)
        try:
            for b in batches:
                for part in textkit.slices(b):
                    ids = enc.encode([x or "" for x in part.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *row(enc, ids)], names=names)
        finally:
            # workers live on: what one task needed would add to the next one's
            del enc
            encoder.cache_clear()

    return of


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    textkit.bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the token ids of the whole text; a null or empty text has none.

    One row per input row, repeated and null ids included.  ``path`` names a rank
    file that every executor can open.
    """

    def row(_, ids):
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _source(docs, doc_id, text).mapInArrow(textkit.releasing(_each(path, pattern, row, ["doc_id", "ids"])), "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ``ids``; null ids give empty bytes, an id outside the vocabulary is an error."""

    def of(batches):
        enc = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(textkit.releasing(of), "doc_id bigint, data binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep a digest of each."""

    def row(enc, ids):
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string()),
        ]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _source(docs, doc_id, text).mapInArrow(textkit.releasing(_each(path, pattern, row, names)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
