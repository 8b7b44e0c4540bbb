"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage h is encoded
from byte-class shares, word shapes and repetition, and weighted by gated attention

    a = softmax over passages of w . (tanh(V h) * sigmoid(U h))
    z = sum a h          score = sigmoid(c . z + b)

Only document labels are needed: the attention learns which passages decide.  Words
are learned too: each of ``WORDS`` hash groups has the log odds of standing in good rather
than bad documents, and a passage carries the mean over its words, the mean of the bad
ones, and the share of words that were met.  For fitting, one half of the sample is
encoded with the odds of the other half, so that the net does not trust what it has seen.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of
text a class, in order of a hash of the id; the classes are weighted back to their shares
among the labelled rows.  Scoring reads every whole text.

Defined results: a text without a word is one passage of zeros and is scored like
any other; with one class or none to learn from, every score is the share of good
labels (0.5 without labels); a null label is no label; an id labelled twice counts
as good if one of its rows says so; repeated rows each give a row; a null id is scored
and not held out; an empty table gives an empty result; a text of any length is read
whole, at about 100 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

PASSAGE = 50
SAMPLE = 2000
SAMPLE_BYTES = 8 << 20
HIDDEN = 12
STEPS = 400
#: Hash groups of words, and the largest log odds of one.
WORDS = 1 << 16
ODDS = 3.0

#: Byte classes whose shares are features.
CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": b".,;:?'-\"",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~()",
    "other": range(128, 256),
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
FEATURES = len(CLASSES) + 9


def _groups(w: textkit.Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)


def word_odds(texts: pa.Array, good: np.ndarray) -> np.ndarray:
    """Log odds of each hash group, from the number of good and of bad texts that hold it; NaN for groups in fewer than two."""
    n = np.zeros((2, WORDS))
    at = 0
    for b in textkit.slices(pa.record_batch([texts], ["text"])):
        w = textkit.words(b.column(0), False)
        pair = np.unique(w.doc * WORDS + _groups(w))
        y = good[at : at + b.num_rows][pair // WORDS].astype(bool)
        for k in (0, 1):
            n[k] += np.bincount(pair[y == bool(k)] % WORDS, minlength=WORDS)
        at += b.num_rows
    total = np.maximum(1, [(~good.astype(bool)).sum(), good.astype(bool).sum()])
    out = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    return np.where(n.sum(0) >= 2, np.clip(out, -ODDS, ODDS), np.nan).astype(np.float32)


def passages(texts: pa.Array, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each text (one more at the end)."""
    w = textkit.words(texts, False)
    per = np.maximum(1, -(-w.count // PASSAGE))
    at = np.append(0, np.cumsum(per))
    x = np.zeros((at[-1], FEATURES))
    if not len(w):
        return x, at
    within = np.arange(len(w)) - w.at[w.doc]
    own = at[w.doc] + within // PASSAGE
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    p = own[first]
    last = np.append(first[1:], len(w)) - 1
    lo, hi = w.starts[first], w.ends[last]
    length = (hi - lo).astype(float)
    inside = np.repeat(p, hi - lo)
    spot = np.repeat(lo, hi - lo) + np.arange(len(inside)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    k = len(CLASSES)
    shares = np.bincount(inside * (k + 1) + _CLASS[w.buf[spot]], minlength=len(x) * (k + 1)).reshape(-1, k + 1)[p, :k]
    x[p, :k] = shares / length[:, None]
    words = (last - first + 1).astype(float)
    size = w.ends - w.starts
    mean = lambda v: np.add.reduceat(v.astype(float), first) / words
    x[p, k] = np.log1p(mean(size)) / 3
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
    x[p, k + 1] = mean(same)
    key = textkit.mix(w.hash + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(w), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    x[p, k + 2] = mean(dup)
    # words that stand a second time in the same neighbourhood of two words, anywhere before in the text
    g, doc = textkit.doc_grams(w, 3)
    if len(g):
        key = textkit.mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(g), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        spots = np.flatnonzero(w.doc[: len(w) - 2] == w.doc[2:])
        x[:, k + 3] = np.bincount(own[spots], again, len(x)) / np.maximum(1, np.bincount(own[spots], minlength=len(x)))
    x[p, k + 4] = mean(size > 20)
    x[p, k + 5] = np.minimum(words / PASSAGE, 1)
    known = odds[_groups(w)]
    met = ~np.isnan(known)
    known = np.where(met, known, 0.0)
    x[p, k + 6], x[p, k + 7], x[p, k + 8] = mean(known), mean(np.minimum(known, 0)), mean(met)
    return x, at


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float
    odds: np.ndarray | None = None

    def score(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention of each passage."""
        h = (x - self.mean) / self.scale
        z, a, *_ = _forward(h, at, self.V, self.U, self.w)
        return 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -40, 40))), a


def _forward(h, at, V, U, w):
    t, s = np.tanh(h @ V), 1 / (1 + np.exp(-np.clip(h @ U, -40, 40)))
    e = (t * s) @ w
    n = np.diff(at)
    top = np.repeat(np.maximum.reduceat(e, at[:-1]), n)
    a = np.exp(e - top)
    a /= np.repeat(np.add.reduceat(a, at[:-1]), n)
    return np.add.reduceat(h * a[:, None], at[:-1], axis=0), a, t, s


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float) -> Net:
    """Full-batch Adam on the weighted log loss."""
    rnd = np.random.default_rng(11)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    p = {"V": rnd.normal(0, 0.3, (FEATURES, HIDDEN)), "U": rnd.normal(0, 0.3, (FEATURES, HIDDEN)), "w": rnd.normal(0, 0.3, HIDDEN), "c": np.zeros(FEATURES), "b": np.array(0.0)}
    share = min(max(share, 1e-6), 1 - 1e-6)
    if len(set(y.tolist())) < 2:
        return Net(mean, scale, p["V"], p["U"], p["w"], p["c"], float(np.log(share / (1 - share))))
    h, n = (x - mean) / scale, np.diff(at)
    weight = weight / weight.sum()
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        z, a, t, s = _forward(h, at, p["V"], p["U"], p["w"])
        q = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))
        d = weight * (q - y)
        g = {"c": z.T @ d + 1e-4 * p["c"], "b": d.sum()}
        dz = np.repeat(np.outer(d, p["c"]), n, 0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), n))
        g["w"] = (t * s).T @ de + 1e-4 * p["w"]
        dts = np.outer(de, p["w"])
        g["V"] = h.T @ (dts * s * (1 - t * t)) + 1e-4 * p["V"]
        g["U"] = h.T @ (dts * t * s * (1 - s)) + 1e-4 * p["U"]
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.05 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, p["V"], p["U"], p["w"], p["c"], float(p["b"]))


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, quality)."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts, n = textkit.labelled_sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)
    y = np.repeat([0.0, 1.0], [len(t) for t in texts])
    weight = np.concatenate([np.full(len(t), k / max(1, len(t))) for t, k in zip(texts, n, strict=True)])
    both = pa.concat_arrays(texts)
    half = np.arange(len(both)) % 2
    x, size = [None] * 2, np.zeros(len(both), np.int64)
    for k in (0, 1):
        odds = word_odds(both.filter(pa.array(half != k)), y[half != k])
        parts = [passages(b.column(0), odds) for b in textkit.slices(pa.record_batch([both.filter(pa.array(half == k))], ["text"]))]
        x[k] = np.concatenate([np.zeros((0, FEATURES)), *(p for p, _ in parts)])
        size[half == k] = np.concatenate([np.zeros(0, np.int64), *(np.diff(a) for _, a in parts)])
    own = np.repeat(half, size)
    rows = np.empty((len(own), FEATURES))
    for k in (0, 1):
        rows[own == k] = x[k]
    net = train(rows, np.append(0, np.cumsum(size)), y, weight, n[1] / sum(n) if sum(n) else 0.5)
    net.odds = word_odds(both, y)
    del texts, both, x, rows, own
    textkit._pow.clear()
    textkit.free(docs.sparkSession)
    return net


def score(docs: DataFrame, net: Net, keep: dict[str, str], threshold: float = 0.3, attention: bool = True) -> DataFrame:
    """The columns ``keep`` (name to type), score, predicted and each passage's attention, of every row."""

    def of(batches):
        for batch in batches:
            for part in textkit.slices(batch):
                x, at = passages(part.column("text"), net.odds)
                p, a = net.score(x, at)
                cols = [*(part.column(k) for k in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                if attention:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(a.astype(np.float32))))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted", *["attention"] * attention])

    types = ", ".join(f"{k} {t}" for k, t in keep.items())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(textkit.releasing(of), f"{types}, score double, predicted int" + ", attention array<float>" * attention)


def keep_good(docs: DataFrame, net: Net, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns.

    Null and empty texts are scored like any other; rows with equal ids are judged one by
    one; an empty table gives an empty result; other columns keep their values and names.
    """

    def of(batches):
        for batch in batches:
            for part in textkit.slices(batch, text):
                x, at = passages(part.column(text), net.odds)
                yield part.filter(pa.array(net.score(x, at)[0] >= threshold))

    textkit.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(textkit.releasing(of), docs.schema)


def fold_of(docs: DataFrame, fold: int, held: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False)))


def fit_fold(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fold: int = 5, held: int = 0) -> tuple[Net, DataFrame]:
    """The net learned from all folds but one, and doc_id, text, held_out of every row."""
    textkit.bounded_batches(docs.sparkSession)
    src = fold_of(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")), fold, held)
    return fit(src.where(~F.col("held_out")), labels.select(labels[doc_id].cast("bigint").alias("doc_id"), labels[quality].cast("int").alias("quality"))), src


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fold: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod ``fold`` is not ``held``; score all rows.  A null doc_id is not held out."""
    net, src = fit_fold(docs, labels, doc_id, text, quality, fold, held)
    return score(src, net, {"doc_id": "bigint", "held_out": "boolean"}, threshold)
