"""N-gram Jaccard join with signature trees, and the classes of its links.

Two documents link when 100 * |x & y| >= PERCENT * |x | y| over distinct word shingles.

1. Documents with equal sets are one *set*, known by the sum of its mixed shingle hashes.
2. Candidates.  Linked sets of sizes a, b differ in at most
   d = (100 - PERCENT) * (a + b) / (100 + PERCENT) shingles.  Shingles are dealt by hash
   into d + 1 + s parts for the largest size of a size class; then at least 1 + s
   parts are equal.  A set does not send its smallest parts, up to s of them (all or none
   of one size), as such parts hold a shingle or two that many texts share.  Equal parts
   have equal sizes, so of two linked sets the one that leaves out larger parts leaves out
   at most s of the equal ones, and both send another: linked sets always meet.  Sets near
   the lower end of the next class send that class's parts too.
3. Meeting is cheap, so a passage that many texts share makes unlike sets meet.  Each
   set has a signature, the parities of its shingles in 4 d buckets; two signatures
   differ in at most |x ^ y| places, so those that differ in more than d cannot link.
   The sets that meet at one part and pass this test, directly or in a chain, are
   candidates; candidates in a chain form a *block*.  A block is cut into chunks of
   bounded bytes, so one large group of copies is never one task.
4. A chunk's sets are joined by a signature tree: leaves hold neighbouring sets, inner
   nodes the OR of their bitmaps, their size range and their least popcount.  A dual
   traversal drops node pairs whose largest possible overlap is too small.  Pairs that
   are left are compared shingle by shingle.  ``classify`` compares all of them, a pair
   of leaves at once, and counts every link; each chunk of a block also meets every
   other chunk, so n unlike near copies of one text take n * n / 2 comparisons.
5. ``one_of_each`` needs the classes only and compares no pair that a chain of links
   already connects: a class of n sets takes n - 1 links.  Between the chunks of one
   block, first a few pivots of the largest class are compared with all its sets; then
   every set outside the largest class is compared with all chunks.

Shingle hashes have 64 bits; a wrong link needs a collision within two near-equal sets.

Defined results: a document without a word has an empty set and is linked with
nothing; with fewer words than a shingle its whole sequence is the one shingle;
repeated rows count as copies; rows with a null id have no links and a null class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, textkit
from .textkit import U64

U32 = np.uint32

SHINGLE = 4
PERCENT = 85
#: Bytes of shingle hashes in one chunk of a block.
CHUNK = 8 << 20
#: Sets in one chunk where every pair is compared.
SETS = 1 << 13
#: Sets at one part that are compared by signature; if more meet, all of them are candidates.
MEET = 100_000
#: Ids that may be broadcast to fetch texts; beyond, the join shuffles.
BROADCAST_IDS = 1 << 20
#: Sets of a leaf; at most 32, as a word of 32 bits names them.
LEAF = 32
FAN = 8
PIVOTS = 8


def doc_sets(w: textkit.Words, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    g, d = textkit.doc_grams(w, shingle)
    at = np.searchsorted(d, np.arange(len(w.count) + 1))
    out = []
    for i, n in enumerate(w.count.tolist()):
        if n >= shingle:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif n:
            out.append(textkit.mix(textkit.grams(w.hash[w.at[i] : w.at[i + 1]], n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Of a set of hashes, as a signed 64-bit number."""
    x = (int(textkit.mix(s + U64(0x2545F4914F6CDD1D)).sum(dtype=U64)) + len(s) * 0x9E3779B97F4A7C15) % 2**64
    return x - 2**64 if x >= 2**63 else x


def classes(percent: int, largest: int = 1 << 36) -> list[tuple[int, int, int, int]]:
    """Size classes as (least size sent, largest size, parts, parts that need not be sent)."""
    out, low, top = [], 0, 1
    while low <= largest:
        d = 2 * top * (100 - percent) // (100 + percent)
        if d:
            slack = d * 6 // 100 + 2
            out.append((max(1, -(-percent * (low + 1) // 100)), top, d + 1 + slack, slack))
        low, top = top, max(top + 1, top * 8 // 5)
    return out


def part_keys(s: np.ndarray, sizes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Hashes of the parts by which a set meets others; the low 6 bits are the size class."""
    n, out = len(s), []
    c = np.zeros(n + 1, U64)
    np.cumsum(textkit.mix(s + U64(0x632BE59BD9B4E019)), out=c[1:])
    for k, (least, top, parts, slack) in enumerate(sizes):
        if not least <= n <= top:
            continue
        # s is sorted, so the parts are consecutive
        cut = np.searchsorted((s >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1, dtype=U64))
        size = np.diff(cut)
        keys = textkit.mix((c[cut[1:]] - c[cut[:-1]]) + textkit.mix(np.arange(parts, dtype=U64) + U64((k + 1) << 40)))
        keys = keys & ~U64(63) | U64(k)
        # fewer than slack + 1 parts are smaller than this one
        out.append(keys[size >= np.partition(size, slack)[slack]])
    return np.concatenate(out) if out else np.zeros(0, U64)


def signature(s: np.ndarray, sizes: list[tuple[int, int, int, int]]) -> bytes:
    """The size of a set, then the parities of its shingles for each of its size classes: class, words, data."""
    n, out = len(s), [np.array([len(s)], np.int64)]
    for k, (least, top, parts, slack) in enumerate(sizes):
        if least <= n <= top:
            words = -(-4 * (parts - 1 - slack) // 64)
            odd = np.bincount((textkit.mix(s + U64(0x3C6EF372FE94F82B)) % U64(words * 64)).astype(np.int64), minlength=words * 64) & 1
            out += [np.array([k, words], np.int64), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)]
    return np.concatenate(out).tobytes()


def _parities(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and parity rows of signatures for one class."""
    size, rows = [], []
    for b in blobs:
        x = np.frombuffer(b, np.int64)
        size.append(x[0])
        at = 1
        while x[at] != k:
            at += 2 + x[at + 1]
        rows.append(x[at + 2 : at + 2 + x[at + 1]])
    return np.array(size), np.stack(rows).view(U64)


class Classes:
    """Class labels with the smaller class relabelled."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.members = {}
        for i, x in enumerate(label.tolist()):
            self.members.setdefault(x, []).append(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    a, b = len(x), len(y)
    if 100 * min(a, b) < percent * max(a, b):
        return False
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (a + b - both)


class Tree:
    """Signature tree: per level OR-combined bitmaps, size ranges and least popcounts."""

    def __init__(self, sets: list[np.ndarray], words: int):
        n = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        own = np.repeat(np.arange(n), self.size)
        spot = textkit.mix(flat + U64(0x94D049BB133111EB)) % U64(words * 64)
        spot = spot.astype(np.int64) + own * (words * 64)
        octets = np.zeros(n * words * 8, np.uint8)
        np.bitwise_or.at(octets, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
        bitmap = octets.view(U64).reshape(n, words)
        self.bitmap, self.ones = bitmap, np.bitwise_count(bitmap).sum(1).astype(np.int64)
        self.levels = []
        m, lo, hi, ones, fan = bitmap, self.size, self.size, self.ones, LEAF
        while True:
            at = np.arange(0, len(m), fan)
            m, lo, hi, ones = np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(ones, at)
            self.levels.append((m, lo, hi, ones))
            fan = FAN
            if len(m) == 1:
                break

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, other: "Tree", percent: int) -> np.ndarray:
        """Which node pairs (of this and of the other tree) can hold a link."""
        m, lo, hi, ones = self.levels[level]
        m2, lo2, hi2, ones2 = other.levels[level]
        ok = (100 * hi[a] >= percent * lo2[b]) & (100 * hi2[b] >= percent * lo[a])
        i = np.flatnonzero(ok)
        for k in range(0, len(i), 4096):
            j = i[k : k + 4096]
            x, y = a[j], b[j]
            shared = np.bitwise_count(m[x] & m2[y]).sum(1).astype(np.int64)
            most = np.minimum(hi[x] - np.maximum(0, ones[x] - shared), hi2[y] - np.maximum(0, ones2[y] - shared))
            ok[j] = (100 + percent) * most >= percent * (lo[x] + lo2[y])
        return ok


def _grown(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int):
    """Trees of both sides (one tree if ``right`` is None), the places of their sets, and the pairs of leaves that can hold a link."""
    sets = left + (right or [])
    largest = max(len(s) for s in sets)
    words = max(1, min(1 << (max(1, 4 * largest // 64 - 1)).bit_length(), (8 << 20) // (8 * len(sets))))
    # neighbours in the tree share their smallest hash, as near copies mostly do
    order = lambda xs: sorted(range(len(xs)), key=lambda i: (xs[i][0], len(xs[i])))
    lo = order(left)
    ro = [len(left) + i for i in order(right)] if right is not None else lo
    t = Tree([sets[i] for i in lo], words)
    u = Tree([sets[i] for i in ro], words) if right is not None else t
    own = right is None
    depth = max(len(t.levels), len(u.levels))
    for x in (t, u):
        while len(x.levels) < depth:
            x.levels.append(x.levels[-1])
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth - 1, 0, -1):
        keep = t.may_link(level, a, b, u, percent)
        a, b = a[keep], b[keep]
        n, m = len(t.levels[level - 1][0]), len(u.levels[level - 1][0])
        same_n, same_m = n == len(t.levels[level][0]), m == len(u.levels[level][0])
        ka = a[:, None] * (1 if same_n else FAN) + np.arange(1 if same_n else FAN)
        kb = b[:, None] * (1 if same_m else FAN) + np.arange(1 if same_m else FAN)
        a, b = np.repeat(ka, kb.shape[1], 1).ravel(), np.tile(kb, (1, ka.shape[1])).ravel()
        ok = (a < n) & (b < m) & ((a <= b) if own else True)
        a, b = a[ok], b[ok]
    keep = t.may_link(0, a, b, u, percent)
    a, b = a[keep], b[keep]
    near = np.argsort(np.abs(a - b), kind="stable")  # leaves beside each other first: they merge classes early
    return t, u, np.array(lo), np.array(ro), a[near], b[near]


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of ``label`` over left (and right) sets; right None: left with itself.

    ``label`` numbers left sets, then right ones; sets of one class are not compared, so
    these links give the classes and not their number (``all_links`` does).
    """
    sets = left + (right or [])
    t, u, lo, ro, a, b = _grown(left, right, percent)
    own = right is None
    links, cls = [], Classes(label.copy())
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = np.arange(x * LEAF, min(len(lo), (x + 1) * LEAF)), np.arange(y * LEAF, min(len(ro), (y + 1) * LEAF))
        differ = cls.label[lo[p]][:, None] != cls.label[ro[q]][None, :]
        if own and x == y:
            differ &= p[:, None] < q[None, :]
        if not differ.any():
            continue
        i, j = np.nonzero(differ)
        i, j = p[i], q[j]
        shared = np.bitwise_count(t.bitmap[i] & u.bitmap[j]).sum(1).astype(np.int64)
        most = np.minimum(t.size[i] - (t.ones[i] - shared), u.size[j] - (u.ones[j] - shared))
        ok = ((100 + percent) * most >= percent * (t.size[i] + u.size[j])) & (100 * np.minimum(t.size[i], u.size[j]) >= percent * np.maximum(t.size[i], u.size[j]))
        for g, h in zip(lo[i[ok]].tolist(), ro[j[ok]].tolist(), strict=True):
            if cls.label[g] != cls.label[h] and linked(sets[g], sets[h], percent):
                links.append((g, h))
                cls.join(g, h)
    return links


def _leaf(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a leaf's sets in order, and for each the sets that hold it, a bit a set."""
    flat = np.concatenate(sets)
    bit = np.repeat(U32(1) << np.arange(len(sets), dtype=U32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[at], np.bitwise_or.reduceat(bit[order], at)


def _overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes each set of one leaf shares with each set of another; ``x``, ``y``: which sets hold each common hash."""
    out = np.zeros((LEAF, LEAF), np.int64)
    bits = np.arange(LEAF, dtype=U32)
    for k in range(0, len(x), 1 << 15):
        b = [((m[k : k + (1 << 15), None] >> bits) & U32(1)).astype(np.float32) for m in (x, y)]
        out += (b[0].T @ b[1]).astype(np.int64)
    return out


def all_links(left: list[np.ndarray], right: list[np.ndarray] | None, copies: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each left (and right) set the copies of the sets it links with, and links that join the classes; right None: left with itself.

    Every pair of sets in leaves that can hold a link is compared, whether or not other links connect it.
    """
    sets = left + (right or [])
    t, u, lo, ro, a, b = _grown(left, right, percent)
    own = right is None
    count, edges, cls = np.zeros(len(sets), np.int64), [], Classes(np.arange(len(sets)))
    cut = [{}, {}]

    def leaf(side: int, order: np.ndarray, x: int):
        if x not in cut[side]:
            cut[side][x] = _leaf([sets[i] for i in order[x * LEAF : (x + 1) * LEAF].tolist()])
        return cut[side][x]

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        g, h = lo[x * LEAF : (x + 1) * LEAF], ro[y * LEAF : (y + 1) * LEAF]
        (hx, mx), (hy, my) = leaf(0, lo, x), leaf(0 if own else 1, ro, y)
        if own and x == y:
            many = (mx & (mx - U32(1))) != 0
            both = _overlaps(mx[many], mx[many])
        else:
            _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
            both = _overlaps(mx[i], my[j])
        both = both[: len(g), : len(h)]
        size = t.size[x * LEAF : (x + 1) * LEAF][:, None] + u.size[y * LEAF : (y + 1) * LEAF][None, :]
        link = 100 * both >= percent * (size - both)
        if own and x == y:
            np.fill_diagonal(link, False)
            count[g] += link @ copies[g]
        else:
            count[g] += link @ copies[h]
            count[h] += copies[g] @ link
        while (new := link & (cls.label[g][:, None] != cls.label[h][None, :])).any():
            i, j = np.unravel_index(int(new.argmax()), new.shape)
            edges.append((int(g[i]), int(h[j])))
            cls.join(*edges[-1])
    return count, edges


def _runs(batches, names: tuple[str, ...]):
    """Rows of sorted batches as lists with equal ``names``; at most one such list is held."""
    key, held = None, []
    for b in batches:
        cols = [b.column(n).to_pylist() for n in names]
        keys = list(zip(*cols, strict=True))
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                if key is not None and keys[lo] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[lo]
                held.append(b.slice(lo, i - lo))
                lo = i
    if held:
        yield key, pa.Table.from_batches(held)


def _edges_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(col: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in col.to_pylist()]


def _join_runs(percent: int):
    """Rows (block, part, fp, data, role, label) sorted by block and part: links among role 0, or of role 1 with role 0."""

    def of(batches):
        for _, t in _runs(batches, ("block", "part")):
            # a row may repeat; a set may stand on both sides
            at = np.unique(np.stack([t["role"].to_numpy().astype(np.int64), t["fp"].to_numpy()], 1), axis=0, return_index=True)[1]
            if len(at) < 2:
                continue
            t = t.take(pa.array(at))
            fp = t["fp"].to_numpy()
            role, sets = t["role"].to_numpy(), _sets(t["data"])
            label = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
            lone, many = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
            if len(lone):
                index = np.concatenate([lone, many])
                if not len(many):
                    continue
                links = tree_join([sets[i] for i in lone], [sets[i] for i in many], label[index], percent)
            else:
                index, links = many, tree_join(sets, None, label, percent)
            if links:
                yield _edges_of([(int(fp[index[i]]), int(fp[index[j]])) for i, j in links])

    return of


def _count_runs(percent: int):
    """Rows (block, part, fp, data, role, copies) sorted by block and part: the links among role 0, or of role 1 with role 2.

    Gives (a, b) for links that join the classes, and (fp, null, n) for the copies of the sets that a set links with.
    """

    def of(batches):
        for _, t in _runs(batches, ("block", "part")):
            at = np.unique(np.stack([t["role"].to_numpy().astype(np.int64), t["fp"].to_numpy()], 1), axis=0, return_index=True)[1]
            if len(at) < 2:
                continue
            # in order of the role
            t = t.take(pa.array(at))
            role, left = t["role"].to_numpy(), int((t["role"].to_numpy() < 2).sum())
            # a chunk without sets meets no other one
            if role[0] and left in (0, len(role)):
                continue
            fp, copies, sets = t["fp"].to_numpy(), t["copies"].to_numpy(), _sets(t["data"])
            count, edges = all_links(sets[:left], sets[left:] if role[0] else None, copies, percent)
            if edges:
                a, b = fp[np.array(edges).T]
                some = np.flatnonzero(count)
                cols = [np.concatenate([a, fp[some]]), np.concatenate([b, fp[some]]), np.concatenate([np.zeros(len(a), np.int64), count[some]])]
                told = np.arange(len(cols[0])) >= len(a)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=told), pa.array(cols[2], mask=~told)], names=["a", "b", "n"])

    return of


def _meet(batches):
    """Rows (key, fp) sorted: those of keys at which two or more sets meet."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        k, f = t["key"].to_numpy(), t["fp"].to_numpy()
        if not len(k):
            continue
        fresh = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]))
        k, f = k[fresh], f[fresh]
        same = k[1:] == k[:-1]
        many = np.append(False, same) | np.append(same, False)
        # the last row waits for what follows; a row of its key that went before is known by ``many``
        out = many.copy()
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(f[out])], names=["key", "fp"])
        held = pa.RecordBatch.from_arrays([pa.array(k[-1:]), pa.array(f[-1:])], names=["key", "fp"])


def _compatible(size, bits, i, j, d, percent):
    ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(1) <= d
    return ok


def chains(size: np.ndarray, bits: np.ndarray, d: int, percent: int) -> list[tuple[int, int]]:
    """Compatible pairs that connect all sets connected by compatible pairs."""
    n = len(size)
    cls, out = Classes(np.arange(n)), []

    def take(i, j):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if cls.label[x] != cls.label[y]:
                out.append((x, y))
                cls.join(x, y)

    i = np.arange(n - 1)
    ok = _compatible(size, bits, i, i + 1, d, percent)
    take(i[ok], i[ok] + 1)
    for k in range(PIVOTS):
        big = max(cls.members.values(), key=len)
        rest = np.flatnonzero(cls.label != cls.label[big[0]])
        if not len(rest):
            return out
        pivot = np.full(len(rest), big[k * len(big) // PIVOTS])
        ok = _compatible(size, bits, rest, pivot, d, percent)
        take(rest[ok], pivot[ok])
    big = max(cls.members.values(), key=len)
    for x in np.flatnonzero(cls.label != cls.label[big[0]]).tolist():
        j = np.flatnonzero(cls.label != cls.label[x])
        i = np.full(len(j), x)
        ok = _compatible(size, bits, i, j, d, percent)
        take(i[ok], j[ok])
    return out


def _candidates(sizes: list[tuple[int, int, int, int]], percent: int):
    """Rows (key, fp, sig) sorted by key: candidate pairs that connect what can link."""
    meet = MEET

    def group(fp: np.ndarray, blobs: list[bytes], k: int):
        size, bits = _parities(blobs, k)
        return [(int(fp[i]), int(fp[j])) for i, j in chains(size, bits, sizes[k][2] - 1 - sizes[k][3], percent)]

    def of(batches):
        seen: set[tuple[int, int]] = set()
        key, fps, sigs, leader = None, [], [], None

        def done():
            if leader is not None:
                return [(leader, x) for x in fps[1:]]
            return group(np.array(fps), sigs, key & 63) if len(fps) > 1 else []

        for b in batches:
            found: list[tuple[int, int]] = []
            k, f, g = b.column("key").to_numpy(), b.column("fp").to_numpy(), b.column("sig")
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(k)))
            # pairs that lie inside the batch are compared together, class by class
            pair = np.zeros(len(cut), bool)
            pair[1:-1] = size[1:-1] == 2
            lone = cut[pair]
            for c in np.unique(k[lone] & 63).tolist():
                at = lone[k[lone] & 63 == c]
                x, y = _parities(g.take(pa.array(at)).to_pylist(), c), _parities(g.take(pa.array(at + 1)).to_pylist(), c)
                n, bits = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
                i = np.arange(len(at))
                ok = _compatible(n, bits, i, i + len(at), sizes[c][2] - 1 - sizes[c][3], percent)
                found += zip(f[at[ok]].tolist(), f[at[ok] + 1].tolist(), strict=True)
            for lo, n in zip(cut[~pair].tolist(), size[~pair].tolist(), strict=True):
                hi = lo + n
                if key is None or k[lo] != key:
                    found += done()
                    key, fps, sigs, leader = int(k[lo]), [], [], None
                fps += f[lo:hi].tolist()
                if leader is None:
                    sigs += g.slice(lo, n).to_pylist()
                if len(fps) > meet:
                    leader = fps[0] if leader is None else leader
                    found += [(leader, x) for x in fps[1:]]
                    fps, sigs = [leader], []
            new = [x for x in dict.fromkeys(found) if x not in seen]
            if len(seen) > 100_000:
                seen.clear()
            seen.update(new)
            if new:
                yield _edges_of(new)
        if last := done():
            yield _edges_of(last)

    return of


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and links (number of other rows it links with, copies too) of every row."""
    return _classified(docs, doc_id, text, shingle, percent, True)[0]


def _classified(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, count: bool) -> tuple[DataFrame, list[DataFrame]]:
    """As ``classify``, and the written frames that the result is read from; links are null unless ``count``."""
    spark = docs.sparkSession
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))

    sizes = classes(percent)

    def measure(batches):
        for batch in batches:
            for part in textkit.slices(batch):
                sets = doc_sets(textkit.words(part.column("text")), shingle)
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([signature(s, sizes) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n", "fp", "sig"])

    textkit.bounded_batches(spark)
    known = textkit.written(src.mapInArrow(textkit.releasing(measure), "doc_id bigint, n bigint, fp bigint, sig binary"), "sets")
    live = known.where("n > 0 AND doc_id IS NOT NULL")
    per_set = live.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"))

    def send(batches):
        known = textkit.Remembered()  # sets of this task; its copies need not be sent twice
        for batch in batches:
            for part in textkit.slices(batch):
                keys, fps = [], []
                sets = [s for s in doc_sets(textkit.words(part.column("text")), shingle) if len(s)]
                prints = np.array([fingerprint(s) for s in sets], np.int64)
                for s, f, fresh in zip(sets, prints.tolist(), known.fresh(prints).tolist(), strict=True):
                    if fresh:
                        k = part_keys(s, sizes)
                        keys.append(k.view(np.int64))
                        fps.append(np.full(len(k), f, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps))], names=["key", "fp"])

    sent = src.where("doc_id IS NOT NULL").select("text").mapInArrow(textkit.releasing(send), "key bigint, fp bigint")
    sent = sent.repartition("key").sortWithinPartitions("key", "fp")
    with textkit.batches_of(spark, 20_000):
        met = textkit.written(sent.mapInArrow(textkit.releasing(_meet), "key bigint, fp bigint"), "met")
    del sent
    textkit.free(spark)
    signed = met.join(live.select("fp", "sig").dropDuplicates(["fp"]), "fp").repartition("key").sortWithinPartitions("key", "fp")
    with textkit.batches_of(spark, 20_000):
        edges = textkit.written(signed.mapInArrow(textkit.releasing(_candidates(sizes, percent)), "a bigint, b bigint").distinct(), "candidates")
    textkit.drop_written(met)
    textkit.free(spark)
    blocks = textkit.written(components.components(edges).join(per_set, F.col("node") == F.col("fp")).select("doc_id", "fp", "n", "copies", F.col("root").alias("block")), "blocks")
    textkit.drop_written(edges)
    links = _links(src, blocks, shingle, percent, count)
    root = textkit.written(components.components(links.select("a", "b")), "classes")
    # a pair of chunks adds its part to a set's links
    degree = links.where("n IS NOT NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("links"))
    classed = per_set.select("fp", "doc_id").join(root.withColumnRenamed("node", "fp"), "fp")
    least = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classed.join(least, "root").join(degree, "fp", "left").select("fp", "component_id", "links")
    of_set = per_set.select("fp", "copies", F.col("doc_id").alias("first")).join(named, "fp", "left")
    of_set = textkit.written(of_set.select("fp", "copies", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count else F.lit(None)).cast("bigint").alias("links")), "named")
    # the copies of one set can be a third of all rows
    own = textkit.joined_by(live.select("doc_id", "n", "fp"), of_set, "fp", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "links")
    rest = known.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("links"))
    for f in (blocks, root, links):
        textkit.drop_written(f)
    textkit.free(spark)
    return own.unionByName(rest), [known, of_set]


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their class.

    An id names one document: rows that share an id stay or go together, and go if one
    of them is linked with a smaller id.  Rows with a null id stay, and so do those without
    a word (null and empty texts).  An empty table gives an empty result; other columns keep
    their values, whatever their names.
    """
    found, held = _classified(docs, doc_id, text, shingle, percent, False)
    gone = textkit.written(found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    for f in held:
        textkit.drop_written(f)
    textkit.free(docs.sparkSession)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[doc_id].cast("bigint") == gone["gone"], "left_anti")


def _links(src: DataFrame, blocks: DataFrame, shingle: int, percent: int, count: bool) -> DataFrame:
    """Links (a, b) between fingerprints that join each class of the blocks' sets; with ``count`` also rows (a, null, n) that add up to the copies a set links with."""
    spark = src.sparkSession

    def fetch(batches):
        for batch in batches:
            for part in textkit.slices(batch):
                sets = doc_sets(textkit.words(part.column("text")), shingle)
                fp = np.array([fingerprint(s) for s in sets], np.int64)
                right = np.flatnonzero(fp == part.column("fp").to_numpy())
                cols = [part.column(c).take(pa.array(right)) for c in ("block", "part", "fp", "copies")]
                data = pa.array([sets[i].tobytes() for i in right.tolist()], pa.binary())
                zero = pa.array(np.zeros(len(right), np.int32))
                yield pa.RecordBatch.from_arrays([*cols[:3], data, zero, cols[3 if count else 2]], names=ROW)

    # a set's label where classes are joined, its copies where links are counted
    last = "copies" if count else "label"
    ROW = ["block", "part", "fp", "data", "role", last]
    TYPE = f"block bigint, part bigint, fp bigint, data binary, role int, {last} bigint"
    size = F.greatest(F.ceil(F.sum("n") * 8 / CHUNK), F.ceil(F.count("*") / SETS)) if count else F.ceil(F.sum("n") * 8 / CHUNK)
    chunks = blocks.groupBy("block").agg(size.cast("int").alias("chunks"))
    placed = blocks.join(chunks, "block").select(F.col("doc_id").alias("id"), "fp", "block", "copies", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("bigint").alias("part"))
    few = blocks.count() <= BROADCAST_IDS
    both = src.join(F.broadcast(placed) if few else placed, F.col("doc_id") == F.col("id")).select("text", "block", "part", "fp", "copies")
    rows = both.mapInArrow(textkit.releasing(fetch), TYPE)
    large = chunks.where("chunks > 1")
    split = large.limit(1).count() > 0
    if split:
        rows = textkit.written(rows, "chunks")

    def joined(r: DataFrame) -> DataFrame:
        r = r.repartition("block", "part").sortWithinPartitions("block", "part")
        if count:
            return r.mapInArrow(textkit.releasing(_count_runs(percent)), "a bigint, b bigint, n bigint")
        return r.mapInArrow(textkit.releasing(_join_runs(percent)), "a bigint, b bigint").withColumn("n", F.lit(None).cast("bigint"))

    if count and split:
        # every chunk of a block meets itself and every later chunk
        both = large.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("q", F.explode(F.sequence("p", F.col("chunks") - 1)))
        task = (F.col("p") * F.lit(1 << 31) + F.col("q")).alias("task")
        role = F.when(F.col("p") == F.col("q"), 0).otherwise(1)
        sides = both.select("block", F.col("p").cast("bigint").alias("part"), task, role.alias("side"))
        sides = sides.union(both.where("p < q").select("block", F.col("q").cast("bigint").alias("part"), task, F.lit(2).alias("side")))
        met = rows.join(sides, ["block", "part"]).select("block", F.col("task").alias("part"), "fp", "data", F.col("side").alias("role"), "copies")
        alone = rows.join(large.select("block"), "block", "left_anti").select(*ROW)
        links = textkit.written(joined(met.unionByName(alone)), "links")
        textkit.drop_written(rows)
        return links
    links = textkit.written(joined(rows), "links")
    if not split:
        return links
    held = [rows, links]
    # blocks of several chunks: pivots of each block's largest class against all its sets, then what is left against all
    inside = rows.join(large.select("block"), "block").withColumn("label", F.col("fp"))

    def labelled(found: DataFrame) -> DataFrame:
        c = components.components(found).select(F.col("node").alias("fp"), "root")
        return inside.drop("label").join(c, "fp", "left").select("block", "part", "fp", "data", "role", F.coalesce("root", "fp").alias("label"))

    def with_size(r: DataFrame) -> DataFrame:
        n = r.groupBy("block", "label").agg(F.count("*").alias("size"))
        top = n.groupBy("block").agg(F.max(F.struct("size", "label")).alias("top")).select("block", F.col("top.label").alias("giant"))
        return r.join(top, "block")

    now = textkit.written(with_size(labelled(links)), "labelled")
    rank = F.row_number().over(_window("block", "part"))
    per_part = now.where("label = giant").select("block", "part", "fp").groupBy("block", "part").agg(F.min("fp").alias("fp"))
    pivots = per_part.withColumn("k", rank).where(F.col("k") <= PIVOTS).select("block", F.col("fp").alias("pivot"))
    data = now.join(pivots.select(F.col("pivot").alias("fp")).distinct(), "fp", "left_semi").select("block", "fp", "data", "label")
    parts = now.select("block", "part").distinct()
    lone = data.join(parts, "block").select("block", "part", "fp", "data", F.lit(1).alias("role"), "label")
    more = textkit.written(joined(now.select(*ROW).unionByName(lone.select(*ROW))), "links")
    held += [now, more]
    links = textkit.written(links.union(more), "links")
    now = textkit.written(with_size(labelled(links)), "labelled")
    rest = now.where("label <> giant")
    # the rest is itself cut into chunks, each of which meets every chunk of its block
    cut = rest.groupBy("block").agg(F.ceil(F.sum(F.length("data")) / CHUNK).cast("int").alias("cuts"))
    lone = rest.join(cut, "block").withColumn("cut", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int")).select("block", "cut", "fp", "data", "label")
    pairs = now.select("block", "part").distinct().join(cut, "block").select("block", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    task = (F.col("part") * F.lit(1 << 31) + F.col("cut")).alias("part")
    one = lone.join(pairs, ["block", "cut"]).select("block", task, "fp", "data", F.lit(1).alias("role"), "label")
    all_ = now.join(pairs, ["block", "part"]).select("block", task, "fp", "data", F.lit(0).alias("role"), "label")
    more = textkit.written(joined(one.unionByName(all_)), "links")
    out = textkit.written(links.union(more), "links")
    for f in (*held, now, more, links):
        textkit.drop_written(f)
    return out


def _window(by: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)
