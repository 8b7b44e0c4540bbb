"""Brown class-based n-gram scoring.

Words are grouped into classes by exchange clustering; a text's probability is the
product of class transitions and word emissions, with one end token a document.

What is counted covers every training text: word counts, and the classes that stand
left and right of every word.  Classes begin with the bigrams between *units*, the
``HEAD`` most frequent words and ``BUCKETS`` groups of all other words with like first
and last bytes: exchange moves one unit at a time to the class that gives the largest
class-bigram likelihood until none moves.  Then every training word outside the head
goes to the class that fits its own left and right counts best, all words at once, in
up to ``PASSES`` passes over the corpus; a pass that lowers the likelihood is undone.
Only a word that no training text has takes the class of its bucket.

A pass meets a word's neighbours by the class of the pass before.  For the ``LOOKUP``
most frequent words a table tells it, and the words of some megabytes of text go on as
one row a word with its packed counts; the head, whose words would be the largest
groups, stays where it is.  A rarer neighbour meets its class in a join, in the passes
as in the class bigrams after them, so the result does not depend on ``LOOKUP``.

    P(text) = prod P(class_i | class_{i-1}) * P(word_i | class_i)
    P(d | c) = (n(c, d) + A) / (n(c) + A * classes)
    P(w | d) = (c(w) + A) / (N_d + A * (V_d + 1))        A = 0.1

Each class keeps one share for the words it has not seen, so all words' shares add
up to 1 in every class.

Counts and classes of the most frequent words go to the executors (a bounded table);
every rarer word meets its own in a shuffle join on the word's hash.

Defined results: a null or empty text is one end token; a null doc_id is scored and
learned from and is not held out; repeated rows each give a row and each count; with
no training row (an empty table too) every count is 0 and the probabilities are the
smoothed uniform ones; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .textkit import U64

A = 0.1
HEAD = 512
BUCKETS = 512
CLASSES = 64
LOOKUP = 1 << 19
#: Word counts that a worker gathers before it passes them on, and words whose neighbours it counts together.
FLUSH = 1 << 20
TOGETHER = 1 << 21
END = HEAD + BUCKETS
UNITS = END + 1
#: Passes that move words outside the head.
PASSES = 2


def _bucket(w: textkit.Words) -> np.ndarray:
    """Bucket of each word from its length class, first byte and last two bytes."""
    last = w.buf[w.ends - 1].astype(np.uint64)
    before = w.buf[np.maximum(w.ends - 2, w.starts)].astype(np.uint64)
    first = w.buf[w.starts].astype(np.uint64)
    return (textkit.mix(last | before << U64(8) | first << U64(16)) % U64(BUCKETS)).astype(np.int64)


def _merge(parts: list[tuple]) -> tuple:
    h, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, b, c = h[order], b[order], c[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], b[at], np.add.reduceat(c, at) if len(at) else c


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), bucket and count over all words of ``text``; pre-added in each task."""

    def of(batches):
        parts, size, most = [], 0, FLUSH

        def out():
            h, b, c = _merge(parts)
            for k in range(0, len(h), 1 << 18):
                s = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(b[s].astype(np.int32)), pa.array(c[s])], names=["word", "bucket", "n"])

        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"))
                h, at, c = np.unique(w.hash, return_index=True, return_counts=True)
                parts.append((h, _bucket(w)[at].astype(np.int16), c.astype(np.int64)))
                size += len(h)
                if size > most:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    if size > FLUSH:
                        yield from out()
                        parts, size = [], 0
                    most = max(FLUSH, 2 * size)
        if parts:
            yield from out()

    return docs.select("text").mapInArrow(textkit.releasing(of), "word bigint, bucket int, n bigint").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def _units(w: textkit.Words, head: np.ndarray) -> np.ndarray:
    """Unit of each word; ``head`` holds sorted hashes."""
    if not len(head):
        return HEAD + _bucket(w)
    i = np.minimum(np.searchsorted(head, w.hash), len(head) - 1)
    return np.where(head[i] == w.hash, i, HEAD + _bucket(w))


def _with_ends(w: textkit.Words, of_word: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens with one end after each document, and where the ends are."""
    at = np.cumsum(w.count + 1) - 1
    out = np.full(len(w) + len(w.count), end, np.int64)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = of_word
    return out, at


def unit_bigrams(docs: DataFrame, head: np.ndarray) -> np.ndarray:
    """UNITS x UNITS counts of neighbouring units; each text starts after an end."""

    def of(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"))
                u, at = _with_ends(w, _units(w, head), END)
                before = np.append(END, u[:-1])
                total += np.bincount(before * UNITS + u, minlength=len(total))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(textkit.releasing(of), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each unit; the last unit (end) keeps the last class to itself."""

    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    units, k = len(bigrams), classes - 1
    mass = bigrams.sum(1) + bigrams.sum(0)
    order = [int(i) for i in np.argsort(-mass, kind="stable") if i != units - 1 and mass[i] > 0]
    of = np.zeros(units, np.int64)
    of[order] = np.arange(len(order)) % k
    of[-1] = k
    one = np.eye(classes)[of]
    right, left = bigrams @ one, bigrams.T @ one
    m = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = of[w], bigrams[w, w]
            r, l, n_r, n_l = right[w].copy(), left[w].copy(), bigrams[w].sum(), bigrams[:, w].sum()
            m[a] -= r
            m[:, a] -= l
            m[a, a] += own
            r[a] -= own
            l[a] -= own
            rows, cols, diag = m.sum(1), m.sum(0), np.diag(m)
            gain = (f(m + r) - f(m)).sum(1) + (f(m.T + l) - f(m.T)).sum(1)
            gain += f(diag + r + l + own) - f(diag + r) - f(diag + l) + f(diag)
            gain -= f(rows + n_r) - f(rows) + f(cols + n_l) - f(cols)
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += r
            m[:, b] += l
            m[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return of


def _known(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted ``known``; -1 where absent."""
    if not len(known):
        return np.full(len(h), -1, np.int64)
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[i] == h, i, -1)


class Lookup:
    """Classes by hash: of the known words (sorted hashes), and of any other by its bucket."""

    def __init__(self, known: np.ndarray, classes: np.ndarray, of_bucket: np.ndarray):
        self.known, self.classes, self.of_bucket = known, classes.astype(np.int8), of_bucket

    def of(self, w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the known ones (-1: none), and its class."""
        i = _known(self.known, w.hash)
        out = self.of_bucket[_bucket(w)]
        hit = i >= 0
        out[hit] = self.classes[i[hit]]
        return i, out


def packed(word: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct words, their own classes, and their neighbours as pairs of bytes: class (left: CLASSES more), count.

    A count above 255 takes several pairs; a neighbour of class -1 is left out.
    """
    order = np.argsort(word)
    fresh = np.append(True, np.diff(word[order]) != 0) if len(word) else np.zeros(0, bool)
    at = order[fresh]
    words = word[at]
    # place and class fit into 32 bits unless one text is very long
    kind = np.int32 if len(words) * 2 * CLASSES < 1 << 31 else np.int64
    back = np.empty(len(word), kind)
    back[order] = np.cumsum(fresh, dtype=kind) - 1
    del order, fresh
    back *= kind(2 * CLASSES)
    key = np.concatenate([(back + right)[right >= 0], (back + kind(CLASSES) + left)[left >= 0]])
    del back
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    pairs = -(-n // 255)
    key, n, pairs = np.repeat(key, pairs), np.repeat(n, pairs), np.repeat(pairs, pairs)
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    data = np.stack([key % (2 * CLASSES), np.where(last, n - 255 * (pairs - 1), 255)], 1).astype(np.uint8)
    edge = 2 * np.searchsorted(key // (2 * CLASSES), np.arange(len(words) + 1))
    near = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return words, own[at], near


def contexts(docs: DataFrame, lookup: Lookup, head: np.ndarray, joined: bool = False) -> DataFrame:
    """word, bucket's class and packed neighbours of the words outside the head, in rows of up to ``TOGETHER`` words of text.

    Neighbours that ``lookup`` does not know have their bucket's class, or with ``joined`` are left to ``rare_contexts``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lookup, head))
    last = CLASSES - 1

    def of(batches):
        lookup, head = shared.value
        held, size = [], 0

        def out():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            words, own, near = packed(*cols)
            del cols
            for k in range(0, len(words), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(words[s].view(np.int64)), pa.array(own[s].astype(np.int8)), near[s]], names=["word", "was", "near"])

        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"))
                i, c = lookup.of(w)
                if joined:
                    c[i < 0] = -1
                v, at = _with_ends(w, c, last)
                keep = np.ones(len(v), bool)
                keep[at] = False
                left, right = np.append(last, v[:-1])[keep], np.append(v[1:], last)[keep]
                some = np.flatnonzero(_known(head, w.hash) < 0)
                held.append((w.hash[some], lookup.of_bucket[_bucket(w)[some]].astype(np.int8), right[some].astype(np.int8), left[some].astype(np.int8)))
                size += len(some)
                if size > TOGETHER:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    return docs.select("text").mapInArrow(textkit.releasing(of), "word bigint, was byte, near binary")


def rare_contexts(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """As ``contexts``, the neighbours without a known class, a row each, by their class in ``classes``; ``pairs`` as ``class_bigrams`` keeps them."""
    right = pairs.where("cb IS NULL AND a IS NOT NULL").select(F.col("b").alias("key"), F.col("a").alias("word"), F.lit(0).alias("side"))
    left = pairs.where("ca IS NULL AND b IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("word"), F.lit(CLASSES).alias("side"))
    one = F.array(*(F.lit(bytes([k, 1])) for k in range(2 * CLASSES)))
    of_word = classes.select(F.col("word").alias("key"), "class")
    # after a first pass ``moved`` does not ask these rows for the class so far
    return right.union(left).join(of_word, "key").select("word", F.lit(0).cast("byte").alias("was"), F.element_at(one, F.col("side") + F.col("class") + 1).alias("near"))


def moved(near: DataFrame, before: DataFrame | None, m: np.ndarray) -> DataFrame:
    """word, n, class: the class that fits a word's neighbours best, its own counts left out of its present class.

    ``near`` as from ``contexts``; ``before``: the classes of the pass before, None if they
    are the buckets'.  One task meets a word's rows one after another and adds them up.
    """
    if before is not None:
        # a word's class so far comes as one more row
        near = near.unionByName(before.select("word", F.col("class").cast("byte").alias("was"), F.lit(None).cast("binary").alias("near")))
    near = near.repartition("word").sortWithinPartitions("word")
    fixed = before is not None

    def of(batches):
        rows, cols = m.sum(1) + A * CLASSES, m.sum(0) + A * CLASSES
        fit_right = np.log((m + A) / rows[:, None] / cols)
        fit_left = fit_right.T

        def best(word, now, x):
            r, l = x[:, :CLASSES], x[:, CLASSES:]
            gain = (r @ fit_right.T + l @ fit_left.T)[:, : CLASSES - 1]
            own = (r * np.log((np.maximum(m[now] - r, 0) + A) / (np.maximum(rows[now] - r.sum(1), A * CLASSES))[:, None] / cols)).sum(1)
            own += (l * np.log((np.maximum(m.T[now] - l, 0) + A) / (np.maximum(cols[now] - l.sum(1), A * CLASSES))[:, None] / rows)).sum(1)
            gain[np.arange(len(word)), now] = own
            top = gain.argmax(1)
            top = np.where(gain[np.arange(len(word)), top] <= own + 1e-9, now, top)
            # a row without counts is a head word's class of the pass before
            some = pa.array(r.sum(1) > 0)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(r.sum(1).astype(np.int64)), pa.array(top.astype(np.int32))], names=["word", "n", "class"]).filter(some)

        tail = None
        for b in batches:
            if not len(b):
                continue
            word, was, near = b.column("word").to_numpy(), b.column("was").to_numpy().astype(np.int64), b.column("near")
            fresh = np.append(True, word[1:] != word[:-1])
            at = np.cumsum(fresh) - 1
            words = word[fresh]
            edges = np.frombuffer(near.buffers()[1], np.int32)[near.offset :][: len(near) + 1]
            size = np.diff(edges) // 2
            data = np.frombuffer(near.buffers()[2], np.uint8)[edges[0] : edges[-1]].reshape(-1, 2) if near.buffers()[2] is not None else np.zeros((0, 2), np.uint8)
            x = np.bincount(np.repeat(at, size) * (2 * CLASSES) + data[:, 0], data[:, 1], len(words) * 2 * CLASSES).reshape(len(words), 2 * CLASSES)
            now = np.full(len(words), -1)
            # with a pass before, the row without neighbours tells the class; all rows agree otherwise
            told = near.is_null().to_numpy(zero_copy_only=False) if fixed else np.ones(len(word), bool)
            now[at[told]] = was[told]
            if tail is not None:
                if tail[0] == words[0]:
                    x[0] += tail[2]
                    now[0] = max(now[0], tail[1])
                else:
                    yield best(np.array([tail[0]]), np.array([tail[1]]), tail[2][None])
            tail = words[-1], now[-1], x[-1].copy()
            if len(words) > 1:
                yield best(words[:-1], now[:-1], x[:-1])
        if tail is not None:
            yield best(np.array([tail[0]]), np.array([tail[1]]), tail[2][None])

    with textkit.batches_of(near.sparkSession, 10_000):
        return textkit.written(near.mapInArrow(textkit.releasing(of), "word bigint, n bigint, class int"), "brown-classes")


def class_bigrams(docs: DataFrame, classes: DataFrame, known: np.ndarray, known_class: np.ndarray, head: np.ndarray, rare: bool) -> tuple[np.ndarray, DataFrame | None]:
    """CLASSES x CLASSES counts of neighbouring classes; each text starts after an end.

    ``classes``: word and class of all training words; ``known`` holds sorted hashes of the
    frequent ones.  Of a pair with another word, that word's class comes by a join; with
    ``rare`` the written pairs are returned too, where a word is null if it is an end or of
    the head, and a class is null if it comes by the join.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, known_class.astype(np.int8), head))
    last = CLASSES - 1
    names = ["a", "b", "ca", "cb", "n"]

    def of(batches):
        known, cls, head = shared.value
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"))
                i = _known(known, w.hash)
                c = np.full(len(w), -1, np.int64)
                c[i >= 0] = cls[i[i >= 0]]
                c, _ = _with_ends(w, c, last)
                before = np.append(last, c[:-1])
                both = (c >= 0) & (before >= 0)
                total += np.bincount(before[both] * CLASSES + c[both], minlength=len(total))
                if len(rest := np.flatnonzero(~both)):
                    h = _with_ends(w, w.hash.view(np.int64), 0)[0]
                    a, b = np.append(0, h[:-1])[rest], h[rest]
                    ca, cb = before[rest], c[rest]
                    idle = [(c == last) | (_known(head, x.view(U64)) >= 0) for x, c in ((a, ca), (b, cb))]
                    cols = [pa.array(a, mask=idle[0]), pa.array(b, mask=idle[1]), pa.array(ca.astype(np.int8), mask=ca < 0), pa.array(cb.astype(np.int8), mask=cb < 0), pa.array(np.ones(len(rest), np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array((at // CLASSES).astype(np.int8)), pa.array((at % CLASSES).astype(np.int8)), pa.array(total[at])], names=names)

    rows = docs.select("text").mapInArrow(textkit.releasing(of), "a bigint, b bigint, ca byte, cb byte, n bigint")
    if rare:
        rows = textkit.written(rows, "brown-pairs")
        of_word = classes.select("word", F.col("class").cast("byte").alias("class"))
        # pairs by the side whose class is still wanted; what shares a key is added up before it is sent
        lone_a = rows.where("ca IS NULL AND cb IS NOT NULL").groupBy("a", "cb").agg(F.sum("n").alias("n"))
        lone_a = lone_a.join(of_word, F.col("a") == F.col("word")).select(F.col("class").alias("ca"), "cb", "n")
        lone_b = rows.where("ca IS NOT NULL AND cb IS NULL").groupBy("b", "ca").agg(F.sum("n").alias("n"))
        lone_b = lone_b.join(of_word, F.col("b") == F.col("word")).select("ca", F.col("class").alias("cb"), "n")
        two = rows.where("ca IS NULL AND cb IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
        two = two.join(of_word, F.col("a") == F.col("word")).select(F.col("class").alias("ca"), "b", "n").groupBy("b", "ca").agg(F.sum("n").alias("n"))
        two = two.join(of_word, F.col("b") == F.col("word")).select("ca", F.col("class").alias("cb"), "n")
        all_ = rows.where("ca IS NOT NULL AND cb IS NOT NULL").select("ca", "cb", "n").unionByName(lone_a).unionByName(lone_b).unionByName(two)
    else:
        all_ = rows.select("ca", "cb", "n")
    cells = all_.groupBy("ca", "cb").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((CLASSES, CLASSES))
    out[cells["ca"].to_numpy(), cells["cb"].to_numpy()] = cells["n"].to_numpy()
    return out, rows if rare else None


def likelihood(m: np.ndarray) -> float:
    """Logarithm of the class bigrams' likelihood, but for what no class changes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(m) - f(m.sum(0)) - f(m.sum(1))


@dataclass
class Model:
    counts: DataFrame  # word, n, class: every training word
    of_bucket: np.ndarray  # class of each bucket, for words that are not in ``counts``
    transition: np.ndarray  # log10 P(next class | class)
    spread: np.ndarray  # log10 of each class's emission denominator
    tokens: int  # N, ends included
    types: int  # V, the end included
    ends: int  # count of the end token
    known: np.ndarray  # sorted hashes of the LOOKUP most frequent words
    known_n: np.ndarray  # their counts
    known_class: np.ndarray  # their classes


def _least_count(counts: DataFrame) -> int:
    """The smallest count for which at most ``LOOKUP`` words have it or more, to about one part in 32.

    Found from a histogram of at most 32 steps an octave, so no task holds all such words.
    """
    step = F.floor(F.log2("n") * 32).cast("int")
    above = 0
    least = None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), reverse=True):
        above += r["words"]
        if above > LOOKUP:
            break
        least = r["n"]
    return least if least is not None else 1 << 62


def _frequent(classes: DataFrame, least: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, counts and classes of the words with a count of ``least`` or more, and of the head, whose classes are not the buckets'."""
    top = classes.where((F.col("n") >= least) | F.col("word").isin(head.view(np.int64).tolist())).select("word", "n", "class").toArrow()
    h, n, c = top["word"].to_numpy().view(U64), top["n"].to_numpy(), top["class"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order], c[order]


def fit(docs: DataFrame) -> Model:
    """Learn from every row's ``text``."""
    spark = docs.sparkSession
    counts = textkit.written(word_counts(docs), "brown-counts")
    ends, types = docs.count(), counts.count()
    least = _least_count(counts)
    top = counts.orderBy(F.desc("n"), "word").limit(min(HEAD, LOOKUP)).select("word", "n").toArrow()
    order = np.argsort(top["word"].to_numpy().view(U64))
    head, head_n = top["word"].to_numpy().view(U64)[order], top["n"].to_numpy()[order]
    bigrams = unit_bigrams(docs, head)
    of = exchange(bigrams, CLASSES)
    of_bucket = of[HEAD:END]
    one = np.eye(CLASSES)[of]
    m = one.T @ bigrams @ one

    def first(batches):
        for b in batches:
            i = _known(head, b.column("word").to_numpy().view(U64))
            c = of[np.where(i >= 0, i, HEAD + b.column("bucket").to_numpy())]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(c.astype(np.int32))], names=["word", "n", "class"])

    classes = textkit.written(counts.mapInArrow(textkit.releasing(first), "word bigint, n bigint, class int"), "brown-classes")
    textkit.drop_written(counts)
    own = spark.createDataFrame(pa.table({"word": head.view(np.int64), "n": head_n, "class": of[: len(head)].astype(np.int32)}))
    known = _frequent(classes, least, head)
    pairs = None
    for k in range(PASSES if types > len(head) else 0):
        # before the first pass every rarer word has its bucket's class
        near = contexts(docs, Lookup(known[0], known[2], of_bucket), head, pairs is not None)
        if pairs is not None:
            near = near.unionByName(rare_contexts(pairs, classes))
        rest = moved(near, classes if k else None, m)
        del near
        textkit.free(spark)
        new = rest.unionByName(own)
        new_known = _frequent(new, least, head)
        if pairs is not None:
            textkit.drop_written(pairs)
        new_m, pairs = class_bigrams(docs, new, new_known[0], new_known[2], head, types > len(new_known[0]))
        textkit.free(spark)
        if likelihood(new_m) <= likelihood(m):
            textkit.drop_written(rest)
            break
        textkit.drop_written(old if k else classes)
        old, classes, known, m = rest, new, new_known, new_m
    if pairs is not None:
        textkit.drop_written(pairs)
    per = classes.groupBy("class").agg(F.count("*").alias("types"), F.sum("n").alias("n")).toArrow()
    count, mass = np.zeros(CLASSES), np.zeros(CLASSES)
    count[per["class"].to_numpy()], mass[per["class"].to_numpy()] = per["types"].to_numpy(), per["n"].to_numpy()
    count[-1], mass[-1] = min(ends, 1), ends
    transition = np.log10((m + A) / (m.sum(1, keepdims=True) + A * CLASSES))
    spread = np.log10(mass + A * (count + 1))
    return Model(classes, of_bucket, transition, spread, int(mass.sum()), int(count.sum()), ends, *known)


def score(docs: DataFrame, model: Model, keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (name to type), n_tokens, n_known, train_tokens, base_score, score of every row."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.of_bucket, model.transition, model.spread, model.known, np.log10(model.known_n + A), model.known_class, model.ends))
    names = [*keep, "row", "word", "times", "n_tokens", "found", "sum_log", "classes", "pos", "cls", "prev", "next"]

    def of(batches):
        of_bucket, transition, spread, known, known_log, known_class, ends = shared.value
        last, end_log = CLASSES - 1, float(np.log10(ends + A))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"))
                i = _known(known, w.hash)
                hit = i >= 0
                # class of each token; -1 where it comes by the join
                c, at = _with_ends(w, np.where(hit, known_class[i], -1) if len(known) else i, last)
                before = np.append(last, c[:-1])
                step = np.where((c >= 0) & (before >= 0), transition[before, c], 0.0) - np.where(c >= 0, spread[c], 0.0)
                per = np.add.reduceat(step, np.append(0, at[:-1] + 1)) if len(at) else np.zeros(0)
                docs_n = len(w.count)
                log = np.bincount(w.doc[hit], known_log[i[hit]] if len(known) else None, docs_n) + end_log
                found = np.bincount(w.doc[hit], minlength=docs_n) + (ends > 0)
                ids = row + np.arange(docs_n)
                # a document's own row has a key of its own, so that such rows spread like the words do
                own = textkit.mix(ids.astype(U64) + U64(0x5851F42D4C957F2D)).view(np.int64)
                empty = [pa.nulls(docs_n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(ids), pa.array(own), pa.array(np.zeros(docs_n, np.int64)), pa.array((w.count + 1).astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(log), pa.array(per), *empty], names=names
                )
                rest = np.flatnonzero(~hit)
                n, place = len(rest), np.flatnonzero(c < 0)
                nulls = [pa.nulls(n, part.schema.field(k).type) for k in keep]
                tail = [pa.array(place), *(pa.array(x.astype(np.int32)) for x in (of_bucket[_bucket(w)[rest]], before[place], c[place + 1]))]
                yield pa.RecordBatch.from_arrays(
                    [*nulls, pa.array(ids[w.doc[rest]]), pa.array(w.hash[rest].view(np.int64)), pa.array(np.ones(n, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), *tail], names=names
                )
                row += docs_n

    def stepped(batches):
        """Adds the transitions at words whose class came by the join."""
        _, transition, spread, *_ = shared.value
        for b in batches:
            t = b.column("toks")
            doc = np.repeat(np.arange(len(b)), t.value_lengths().to_numpy())
            x = t.flatten()
            pos, c, before, after = (x.field(k).to_numpy().astype(np.int64) for k in range(4))
            order = np.lexsort((pos, doc))
            doc, c, before, after = doc[order], c[order], before[order], after[order]
            before = np.where(before >= 0, before, np.append(0, c[:-1])) if len(c) else before
            step = transition[before, c] - spread[c] + np.where(after >= 0, transition[c, after], 0.0)
            more = np.bincount(doc, step, len(b)) + b.column("score").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in done[:-1]), pa.array(more)], names=done)

    types = ", ".join(f"{k} {t}" for k, t in keep.items())
    rows = docs.select(*keep, "text").mapInArrow(textkit.releasing(of), f"{types}, row bigint, word bigint, times bigint, n_tokens bigint, found bigint, sum_log double, classes double, pos bigint, cls int, prev int, next int")
    c = F.coalesce("n", F.lit(0))
    times = F.col("times")
    joined = rows.join(model.counts.select("word", "n", "class"), "word", "left")
    # a word's share in the sums is 0 on a document's own row, where times is 0
    sums = joined.groupBy("row").agg(
        *(F.max(k).alias(k) for k in keep),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("found") + F.sum(F.when(c > 0, times).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("sum_log", F.lit(0.0))) + F.sum(times * F.log10(c + F.lit(A)))).alias("_log"),
        F.max("classes").alias("_classes"),
        F.collect_list(F.when(times > 0, F.struct("pos", F.coalesce("class", "cls").alias("cls"), "prev", "next"))).alias("toks"),
    )
    base = float(np.log10(model.tokens + A * (model.types + 1)))
    done = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sums = sums.select(*keep, "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("_log") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("_log") + F.col("_classes")).alias("score"), "toks")
    return sums.mapInArrow(textkit.releasing(stepped), f"{types}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 10, held: int = 0) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod ``fold`` is not ``held``; score all rows."""
    textkit.bounded_batches(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    src = src.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False)))
    model = fit(src.where(~F.col("held_out")))
    return score(src, model, {"doc_id": "bigint", "held_out": "boolean"}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
