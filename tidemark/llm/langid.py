"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so
that any alphabet is told apart letter by letter.  An n-gram of three letters is bound by
multiplying its letters' vectors, each rotated by its place; a text is bundled by adding
its n-grams' vectors.  A language's prototype is the bundle of its training texts; a text
is given the language whose prototype has the largest cosine.

Letters are all code points of a letter category, case folded; one symbol stands for a
run of anything else.  Bundling is linear, so a task adds up the n-grams of its training
texts, bundles them, and sends one vector a language; Spark adds the vectors.  The driver
holds one vector a language.

Defined results: ``und`` with score 0 for a null text or one without a letter, and
for every text if nothing could be learned (an empty table gives an empty result); equal
cosines go to the first language in alphabetical order; repeated rows each give a row and
count as often as they occur; a text of any length is read whole, at about 40 bytes a
letter; columns other than the id, text and language are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

DIM = 1024
#: Bits of a code point.
POINT = 21
MASK = (1 << POINT) - 1
#: N-gram vectors that a worker remembers, and n-grams that it adds up before it bundles them.
CACHE = 1 << 14
FLUSH = 1 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(65536)])


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; all +1 for 0, which stands for a run of no letters."""
    p = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * _SEED
    bits = np.unpackbits(textkit.mix(textkit.mix(p) + _SEED).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram, a packed triple of code points."""
    points, back = np.unique(np.concatenate([grams >> 2 * POINT, grams >> POINT & MASK, grams & MASK]), return_inverse=True)
    v = letter_vectors(points)
    n = len(grams)
    out = np.roll(v, 2, axis=1)[back[:n]]
    out *= np.roll(v, 1, axis=1)[back[n : 2 * n]]
    out *= v[back[2 * n :]]
    return out


class Profiles:
    """N-gram vectors, made when first met; all are forgotten when there are more than ``CACHE``."""

    def __init__(self):
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows, self.used = np.empty((1024, DIM), np.float32), 0

    def _find(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(grams), -1, np.int64)
        i = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[i] == grams, self.place[i], -1)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Rows of distinct n-grams."""
        at = self._find(grams)
        if not (at < 0).any():
            return self.rows[at]
        new = grams[at < 0]
        if self.used + len(new) > CACHE:
            self.known, self.place, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            new = grams
            if len(new) > CACHE:
                return gram_vectors(new)
        if self.used + len(new) > len(self.rows):
            more = min(CACHE, max(2 * len(self.rows), self.used + len(new)))
            self.rows = np.concatenate([self.rows[: self.used], np.empty((more - self.used, DIM), np.float32)])
        self.rows[self.used : self.used + len(new)] = gram_vectors(new)
        known = np.concatenate([self.known, new])
        order = np.argsort(known)
        self.place = np.concatenate([self.place, np.arange(self.used, self.used + len(new))])[order]
        self.known = known[order]
        self.used += len(new)
        return self.rows[self._find(grams)]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; none without a letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    s = np.where(_is_letter()[np.minimum(cp, 65535)], cp, 0)
    if len(high := np.flatnonzero(cp > 65535)):
        s[high] = [c if chr(c).isalpha() else 0 for c in cp[high].tolist()]
    s = np.concatenate([[0], s, [0]])
    s = s[(s > 0) | np.append(True, s[:-1] > 0)]
    if len(s) < 2:
        return none
    if s[-1]:
        s = np.append(s, 0)
    return np.unique(s[:-2] << 2 * POINT | s[1:-1] << POINT | s[2:], return_counts=True)


def bundle(profiles: Profiles, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the n-grams' vectors times their counts, some thousand n-grams at a time."""
    out = np.zeros(DIM)
    for k in range(0, len(grams), 4096):
        out += counts[k : k + 4096].astype(np.float32) @ profiles.vectors(grams[k : k + 4096])
    return out


class Tally:
    """The bundle of each language, from n-grams that are added up before they are bundled."""

    def __init__(self):
        self.profiles, self.sums, self.held, self.size = Profiles(), {}, {}, 0

    def add(self, lang: str, grams: np.ndarray, counts: np.ndarray) -> None:
        self.held.setdefault(lang, []).append((grams, counts))
        self.size += len(grams)
        if self.size > FLUSH:
            self.flush()

    def flush(self) -> None:
        for lang, parts in self.held.items():
            g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            grams, back = np.unique(g, return_inverse=True)
            counts = np.bincount(back, n, len(grams))
            total = self.sums.setdefault(lang, np.zeros(DIM))
            for k in range(0, len(grams), 4096):
                # whole numbers, so that sums do not depend on their order
                total += counts[k : k + 4096] @ self.profiles.vectors(grams[k : k + 4096]).astype(np.float64)
        self.held, self.size = {}, 0


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes of length 1, from ``text`` and non-null ``lang``."""

    def of(batches):
        tally = Tally()
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                g, n = gram_counts(text)
                if len(g):
                    tally.add(lang, g, n)
        tally.flush()
        langs = list(tally.sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([tally.sums[x] for x in langs], pa.list_(pa.float64()))], names=["lang", "sums"])

    rows = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(textkit.releasing(of), "lang string, sums array<double>")
    rows = rows.select("lang", F.posexplode("sums").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x")).toArrow()
    names = np.array(rows["lang"].to_pylist(), object)
    langs = sorted(set(names.tolist()))
    out = np.zeros((len(langs), DIM))
    if langs:
        out[np.searchsorted(np.array(langs, object), names), rows["place"].to_numpy()] = rows["x"].to_numpy()
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (name to type), lang_pred and score (the cosine, at least 0) of every row."""
    langs, prototypes = model

    def of(batches):
        profiles = Profiles()
        for b in batches:
            names, scores = [], []
            for text in b.column("text").to_pylist():
                g, n = gram_counts(text)
                if len(g) and langs:
                    v = bundle(profiles, g, n)
                    cos = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    k = int(np.argmax(cos))
                    names.append(langs[k])
                    scores.append(min(1.0, max(0.0, float(cos[k]))))
                else:
                    names.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    types = ", ".join(f"{k} {t}" for k, t in keep.items())
    return docs.select(*keep, "text").mapInArrow(textkit.releasing(of), f"{types}, lang_pred string, score double")


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 3, held: int = 1) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod ``fold`` is not ``held``; predict all rows.  A null doc_id is not held out."""
    textkit.bounded_batches(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    src = src.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False)))
    return predict(src, fit(src.where(~F.col("held_out"))), {"doc_id": "bigint", "held_out": "boolean"})
