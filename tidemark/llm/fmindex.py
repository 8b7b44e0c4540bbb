"""FM-index over integer sequences: succinct bit vectors, a wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Positions that a search carries at once; its arrays stay near the CPU caches.
AT_ONCE = 1 << 16


class BitVector:
    """Packed bits with a running count a word; ``rank1(i)`` counts ones before i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Rank of a symbol in a prefix, one bit vector a bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        s = symbols
        for k in range(bits - 1, -1, -1):
            one = (s >> k) & 1 == 1
            self.levels.append(BitVector(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])
        # where each symbol's run begins below the last level
        self.origin = np.zeros(1 << bits, np.int64)
        fresh = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        self.origin[s[fresh]] = fresh

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[j], a symbol that occurs, before i[j]."""
        origin = self.origin[c]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            b = level.rank1(i)
            i = np.where(one, zeros + b, i - b)
        return i - origin


class RangeMinimum:
    """Smallest value of any range: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.runs = [values.astype(np.int32)]
        while 2 * (step := 1 << (len(self.runs) - 1)) <= len(values):
            last = self.runs[-1]
            self.runs.append(np.minimum(last[:-step], last[step:]))
        size = max(map(len, self.runs))
        self.at = np.cumsum([0, *map(len, self.runs)])
        self.flat = np.concatenate(self.runs)
        self.runs = None
        # binary logarithm of each length
        self.log = np.zeros(size + 1, np.int8)
        for k in range(1, size.bit_length()):
            self.log[1 << k :] = k

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each [lo, hi), which is not empty."""
        k = self.log[hi - lo]
        at = self.at[k]
        return np.minimum(self.flat[at + lo], self.flat[at + hi - (1 << k.astype(np.int64))])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling); ties by position."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        if k < n:
            second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.append(False, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if k >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search over sequences joined by separators.

    ``symbols``: numbers 0, 1, ... of all sequences, one after another, each of which
    occurs; ``size``: the sequences' lengths.  Suffixes are sorted to ``depth`` symbols,
    which is enough for patterns of up to that length.
    """

    def __init__(self, symbols: np.ndarray, size: np.ndarray, depth: int):
        self.depth = depth
        ends = np.cumsum(size + 1) - 1
        text = np.zeros(len(symbols) + len(size), np.int64)
        keep = np.ones(len(text), bool)
        keep[ends] = False
        text[keep] = symbols + 1
        self.order = suffix_order(text, depth)
        self.owner = np.repeat(np.arange(len(size)), size + 1)[self.order]
        top = int(symbols.max()) + 1 if len(symbols) else 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.last_column = WaveletMatrix(text[self.order - 1], max(1, top.bit_length()))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of patterns with one more symbol c in front."""
        c = c + 1
        r = self.last_column.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.first[c] + r[: len(c)], self.first[c] + r[len(c) :]

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [lo, hi) of each row of symbols; empty if it does not occur."""
        if patterns.shape[1] > self.depth:
            raise ValueError("pattern longer than the sorted depth")
        c = patterns[:, -1] + 1
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            lo, hi = self.extend(patterns[:, j], lo, hi)
        return lo, np.maximum(hi, lo)

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, value: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each end, how many symbols of the stream up to it stand together in a sequence of smaller value.

        ``value``: a number of each sequence; ``own``: the number that the sequence must be
        below, for each end.  Lengths count up to ``depth``; every end has that many symbols.
        """
        smallest = RangeMinimum(value[self.owner])
        out = np.zeros(len(ends), np.int64)
        for a in range(0, len(ends), AT_ONCE):
            live = np.arange(a, min(len(ends), a + AT_ONCE))
            c = stream[ends[live]] + 1
            lo, hi = self.first[c], self.first[c + 1]
            for j in range(self.depth):
                if j:
                    lo, hi = self.extend(stream[ends[live] - j], lo, hi)
                # a match goes on as long as a smaller sequence holds it
                ok = lo < hi
                ok[ok] = smallest.least(lo[ok], hi[ok]) < own[live[ok]]
                live, lo, hi = live[ok], lo[ok], hi[ok]
                out[live] += 1
                if not len(live):
                    break
        return out
