"""Toxic spans by a linear-chain conditional random field.

Two states a token (clean, toxic).  The score of a sequence adds weights of hashed
token features (the word, its prefixes and suffix, its neighbours) and of state
transitions; forward-backward gives every token's marginal.  A document's score is
its largest marginal, and the tokens at or above one half are its offending spans.

Documents are labelled, tokens are not.  The tokens to learn from are labelled
first: greedily take the word or word prefix that occurs in the most toxic sample
documents not yet explained and (almost) never in clean ones.  Copies of one toxic
document do not make all of its words toxic, because one such word explains them
all.  A word that only stands beside already explained ones is added when it follows
so many different words (copies do not add any) that chance would put it into toxic
documents alone with a probability below ``CHANCE``.  The field is then fitted to
these token labels.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of
text a class, taken in order of a hash of the id.  Scoring reads every whole text.  The chain is evaluated for all texts of a slice at once: in a two-state chain the
ratio of the forward scores follows a fractional linear map, maps compose as 2x2
matrices, and runs of tokens are composed first and then joined.

Defined results: a text without a word has score 0 and no span; with no toxic row to
learn from every score is 0; a null label is no label; an id labelled twice counts
as toxic if one of its rows says so; repeated rows each give a row; a null id is scored
and not held out; an empty table gives an empty result; a text of any length is read
whole, its marginals in parts of ``AT_ONCE`` tokens where texts end.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .textkit import U64

SAMPLE = 2000
SAMPLE_BYTES = 8 << 20
BITS = 18
PREFIXES = (3, 4, 5, 6)
RUN = 256
#: Tokens whose marginals are computed together, whole texts at least.
AT_ONCE = 1 << 17
STEPS = 40
#: Largest probability of meeting a word by chance in toxic documents only.
CHANCE = 1e-6
CLEAN_COST = 3


def _tokens(texts: pa.Array) -> textkit.Words:
    return textkit.words(texts, True, textkit._PUNCT)


def _affixes(w: textkit.Words) -> list[np.ndarray]:
    """Hashes of the first 3..6 bytes of each word and of its last 3; 0 where the word is shorter."""
    out = []
    pad = np.append(w.buf, np.zeros(8, np.uint8))
    length = w.ends - w.starts
    for k in PREFIXES:
        h = np.full(len(w), k, U64)
        for j in range(k):
            h = h * U64(0x100000001B3) ^ pad[w.starts + j].astype(U64)
        out.append(np.where(length > k, textkit.mix(h), U64(0)))
    h = np.full(len(w), 99, U64)
    for j in (3, 2, 1):
        h = h * U64(0x100000001B3) ^ pad[np.maximum(w.ends - j, 0)].astype(U64)
    out.append(np.where(length > 3, textkit.mix(h), U64(0)))
    return out


def features(w: textkit.Words) -> np.ndarray:
    """Hashed feature numbers, one row a feature and one column a token; number 0 is the bias, 1 stands for nothing."""
    if not len(w):
        return np.zeros((9, 0), np.int32)
    first = np.zeros(len(w), bool)
    first[w.at[:-1][w.count > 0]] = True
    last = np.append(first[1:], True)
    h = w.hash
    before, after = np.append(U64(0), h[:-1]), np.append(h[1:], U64(0))
    before[first], after[last] = 0, 0
    cols = [h, *_affixes(w), textkit.mix(before + U64(1)), textkit.mix(after + U64(2))]
    top = U64(64 - BITS)
    out = [np.zeros(len(w), np.int64)]
    for i, c in enumerate(cols):
        out.append(np.where(c == 0, 1, 2 + (textkit.mix(c + U64(i << 8)) >> top).astype(np.int64)))
    return np.stack([c.astype(np.int32) for c in out])


def weigh(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sum of each token's feature weights; ``f`` has a row a feature."""
    out = np.zeros(f.shape[1])
    for c in f:
        out += weights[c]
    return out


def spread(f: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Each feature's sum of the values of its tokens."""
    out = np.zeros(size)
    for c in f:
        out += np.bincount(c, values, size)
    return out


def _scan(maps: np.ndarray) -> np.ndarray:
    """Ratios after each map of a chain of fractional linear maps, from ratio 0.

    ``maps``: n x 4 rows (a, b, c, d) for r -> (a r + b) / (c r + d), all at least 0.
    """
    n = len(maps)
    rows = -(-n // RUN)
    m = np.zeros((rows * RUN, 4))
    m[:, [0, 3]] = 1
    m[:n] = maps
    m = m.reshape(rows, RUN, 4)
    a, b, c, d = (np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows))
    for t in range(RUN):
        x, y, z, u = m[:, t].T
        a, b, c, d = x * a + y * c, x * b + y * d, z * a + u * c, z * b + u * d
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    start = np.zeros(rows)
    r = 0.0
    for k in range(rows):
        start[k] = r
        r = (a[k] * r + b[k]) / (c[k] * r + d[k])
    out = np.empty((rows, RUN))
    r = start
    for t in range(RUN):
        x, y, z, u = m[:, t].T
        r = (x * r + y) / (z * r + u)
        out[:, t] = r
    return out.reshape(-1)[:n]


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token; and, as odds of toxic to clean, the forward and the backward part.

    ``emit``: toxic minus clean score; ``first``: where texts begin; ``trans``: 2x2 scores from row to column.
    """
    n = len(emit)
    if not n:
        return emit, emit, emit
    # texts do not touch each other, so long input goes a few at a time
    starts = np.flatnonzero(first)
    cuts = starts[np.unique(np.searchsorted(starts, np.arange(AT_ONCE, n, AT_ONCE), "left").clip(0, len(starts) - 1))]
    cuts = cuts[cuts > 0]
    if len(cuts):
        out = np.empty((3, n))
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, n).tolist(), strict=True):
            out[:, lo:hi] = _marginals(emit[lo:hi], first[lo:hi], trans)
        return out[0], out[1], out[2]
    return _marginals(emit, first, trans)


def _marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e, t = np.exp(np.clip(emit, -40, 40)), np.exp(trans)
    n = len(emit)
    last = np.append(first[1:], True)
    fwd = np.stack([e * t[1, 1], e * t[0, 1], np.full(n, t[1, 0]), np.full(n, t[0, 0])], 1)
    fwd[first] = np.stack([np.zeros(n), e, np.zeros(n), np.ones(n)], 1)[first]
    alpha = _scan(fwd)
    # the backward ratio at i from that at i+1: beta_i(s) = sum_k t[s, k] e_k(i+1) beta_{i+1}(k)
    nxt = np.append(e[1:], 1.0)
    bwd = np.stack([t[1, 1] * nxt, np.full(n, t[1, 0]), t[0, 1] * nxt, np.full(n, t[0, 0])], 1)
    bwd[last] = (0, 1, 0, 1)
    beta = _scan(bwd[::-1])[::-1]
    odds = alpha * beta
    return odds / (1 + odds), alpha, beta


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray

    def mark(self, w: textkit.Words) -> np.ndarray:
        """Marginal of every token."""
        if not len(w):
            return np.zeros(0)
        first = np.zeros(len(w), bool)
        first[w.at[:-1][w.count > 0]] = True
        f = features(w)
        return marginals(weigh(self.weights, f), first, self.trans)[0]


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs in order, one a row."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return np.stack([a[fresh], b[fresh]], 1)


def label_tokens(keys: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels explained from document labels; see the module's text.  ``keys``: hashes of words, then of their prefixes."""
    before = np.append(U64(0), keys[0][:-1])
    rate = np.log(max(1, toxic.sum()) / max(2, len(toxic)))
    chosen: list[int] = []
    counts: dict[int, int] = {}
    member: dict[int, np.ndarray] = {}
    for k, h in enumerate(keys):
        ok = h != 0
        pair = _distinct(h[ok] + U64(k), doc[ok].astype(U64))
        bad = toxic[pair[:, 1].astype(np.int64)]
        neg, n_neg = np.unique(pair[~bad, 0], return_counts=True)
        cut = pair[bad]
        f, at, n = np.unique(cut[:, 0], return_index=True, return_counts=True)
        i = np.minimum(np.searchsorted(neg, f), max(0, len(neg) - 1))
        c = np.where(neg[i] == f, n_neg[i], 0) if len(neg) else np.zeros(len(f), np.int64)
        # almost never in clean documents, for the share of the classes in the sample
        good = (n >= 2) & (c * max(1, toxic.sum()) * 50 <= n * max(1, (~toxic).sum()))
        spots = ok & toxic[doc]
        near = _distinct(h[spots] + U64(k), before[spots])[:, 0]
        contexts = np.searchsorted(near, f, "right") - np.searchsorted(near, f, "left")
        sure = good & (c == 0) & (np.minimum(contexts, n) * rate < np.log(CHANCE))
        chosen += f[sure].tolist()
        for x, a, m in zip(f[good].tolist(), at[good].tolist(), n[good].tolist(), strict=True):
            counts[x], member[x] = m, cut[a : a + m, 1].astype(np.int64)
    left = toxic.copy()
    by_doc = defaultdict(list)
    for x, d in member.items():
        for i in d.tolist():
            by_doc[i].append(x)
    while counts:
        best = max(counts, key=lambda x: (counts[x], x))
        if counts[best] < 2:
            break
        chosen.append(best)
        for i in member[best].tolist():
            if left[i]:
                left[i] = False
                for x in by_doc[i]:
                    counts[x] -= 1
        counts.pop(best)
    picked = np.sort(np.array(chosen, U64))
    out = np.zeros(len(doc), bool)
    for k, h in enumerate(keys):
        if len(picked):
            i = np.minimum(np.searchsorted(picked, h + U64(k)), len(picked) - 1)
            out |= (h != 0) & (picked[i] == h + U64(k))
    return out & toxic[doc]


def train(texts: pa.Array, toxic: np.ndarray) -> Field:
    """Fit by full-batch adaptive gradient steps on the penalised likelihood."""
    field = Field(np.zeros((1 << BITS) + 2), np.zeros((2, 2)))
    field.weights[0] = -30.0
    # a slice at a time, so that only what is kept of a token takes memory; the keys are
    # gone before there are features, which take the same room
    parts = pa.record_batch([texts], ["text"])
    keys, docs, start = [[] for _ in PREFIXES], [np.zeros(0, np.int64)], 0
    for b in textkit.slices(parts):
        w = _tokens(b.column(0))
        for k, h in zip(keys, [w.hash, *_affixes(w)[1:-1]] if len(w) else [w.hash] * len(PREFIXES), strict=True):
            k.append(h)
        docs.append(w.doc + start)
        start += b.num_rows
    doc = np.concatenate(docs)
    del docs
    if not toxic.any() or not len(doc):
        return field
    for i in range(len(keys)):
        keys[i] = np.concatenate(keys[i])
    y = label_tokens(keys, doc, toxic)
    del keys
    textkit.trim()
    if not y.any():
        return field
    first = np.append(True, doc[1:] != doc[:-1])
    f, at = np.empty((len(PREFIXES) + 5, len(doc)), np.int32), 0
    for b in textkit.slices(parts):
        w = _tokens(b.column(0))
        f[:, at : at + len(w)] = features(w)
        at += len(w)
    size = len(field.weights)
    seen = spread(f, y.astype(float), size)
    weights, trans = np.zeros(size), np.zeros((2, 2))
    weights[0] = -4.0
    square, square_t = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    inner = np.flatnonzero(~first)
    have = np.zeros((2, 2))
    np.add.at(have, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    for step in range(STEPS):
        emit = weigh(weights, f)
        p, alpha, beta = marginals(emit, first, trans)
        g = spread(f, p - y, size) + 1e-3 * weights
        gt = _steps(emit, alpha, beta, inner, np.exp(trans)) - have + 1e-3 * trans
        del emit, p, alpha, beta
        square += g * g
        square_t += gt * gt
        rate = 1.0 if step < STEPS // 2 else 0.5
        weights -= rate * g / np.sqrt(square)
        trans -= 0.3 * rate * gt / np.sqrt(square_t)
    _calibrate(weights, trans, f, first, doc, toxic)
    # a feature that stood on no toxic token may lower a score but not raise it
    weights[(seen == 0) & (weights > 0)] = 0
    return Field(weights, trans)


def _steps(emit: np.ndarray, alpha: np.ndarray, beta: np.ndarray, inner: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Expected number of each transition into the tokens ``inner``, ``AT_ONCE`` of them at a time."""
    out = np.zeros((2, 2))
    for k in range(0, len(inner), AT_ONCE):
        i = inner[k : k + AT_ONCE]
        e, a, b = np.exp(np.clip(emit[i], -40, 40)), alpha[i - 1], beta[i]
        joint = np.stack([np.stack([np.full(len(a), t[0, 0]), t[0, 1] * e * b]), np.stack([a * t[1, 0], a * t[1, 1] * e * b])])
        out += (joint / joint.sum((0, 1))).sum(2)
    return out


def _calibrate(weights: np.ndarray, trans: np.ndarray, f: np.ndarray, first: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> None:
    """Move the bias so that one half is the document score that errs least on the sample; a clean text flagged counts as ``CLEAN_COST`` toxic ones missed."""
    p = np.clip(marginals(weigh(weights, f), first, trans)[0], 1e-9, 1 - 1e-9)
    best = np.full(len(toxic), -30.0)
    np.maximum.at(best, doc, np.log(p / (1 - p)))
    bad, good = np.sort(best[toxic]), np.sort(best[~toxic])
    cuts = np.arange(-2, 4.01, 0.25)
    cost = np.searchsorted(bad, cuts) + CLEAN_COST * (len(good) - np.searchsorted(good, cuts))
    weights[0] -= cuts[np.argmin(cost)]


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, toxic)."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts, _ = textkit.labelled_sample(docs, labels, "toxic", SAMPLE, SAMPLE_BYTES)
    field = train(pa.concat_arrays(texts), np.repeat([False, True], [len(t) for t in texts]))
    del texts
    textkit._pow.clear()
    textkit.free(docs.sparkSession)
    return field


SPANS = "array<struct<start:bigint,end:bigint,text:string,p:double>>"


def score(docs: DataFrame, field: Field, keep: dict[str, str], spans: bool = True) -> DataFrame:
    """The columns ``keep`` (name to type), score, predicted and the offending spans (byte offsets) of every row."""
    used = np.flatnonzero(field.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, field.weights[used], field.trans))

    def of(batches):
        at, value, trans = shared.value
        weights = np.zeros((1 << BITS) + 2)
        weights[at] = value
        f = Field(weights, trans)
        for batch in batches:
            for part in textkit.slices(batch):
                w = _tokens(part.column("text"))
                p = f.mark(w)
                n = len(w.count)
                best = np.zeros(n)
                full = np.flatnonzero(w.count > 0)
                if len(full):
                    best[full] = np.maximum.reduceat(p, w.at[:-1][full])
                best = np.clip(best, 0, 1)
                cols = [*(part.column(k) for k in keep), pa.array(best), pa.array((best >= 0.5).astype(np.int32))]
                if spans:
                    found = [[] for _ in range(n)]
                    for i in np.flatnonzero(p >= 0.5).tolist():
                        d, lo, hi = int(w.doc[i]), int(w.starts[i]), int(w.ends[i])
                        found[d].append({"start": lo - int(w.bounds[d]), "end": hi - int(w.bounds[d]), "text": w.raw[lo:hi].tobytes().decode("utf-8", "replace"), "p": float(p[i])})
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("p", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted", *["spans"] * spans])

    types = ", ".join(f"{k} {t}" for k, t in keep.items())
    return docs.select(*keep, "text").mapInArrow(textkit.releasing(of), f"{types}, score double, predicted int" + f", spans {SPANS}" * spans)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fold: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod ``fold`` is not ``held``; score all rows.  A null doc_id is not held out."""
    textkit.bounded_batches(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    src = src.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False)))
    field = fit(src.where(~F.col("held_out")), labels.select(labels[doc_id].cast("bigint").alias("doc_id"), labels[toxic].cast("int").alias("toxic")))
    return score(src, field, {"doc_id": "bigint", "held_out": "boolean"})
