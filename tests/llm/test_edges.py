"""Every operator on null, empty and very long texts, ties and repeated rows, empty tables and clashing names; scores recomputed plainly."""

import itertools
import math
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, brown, decontaminate, langid, media, nearjoin, quality, setjoin, substring, textkit, toxicity

from . import brute

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(1, None), (2, ""), (3, " \t"), (4, SAME), (4, SAME), (5, SAME), (6, "idiot " + SAME), (7, LONG), (8, "Ünïcode ß 漢字 🙂"), (None, SAME), (9, "x")]
#: Names that the operators use for columns of their own.
CLASH = ["key", "fp", "seq", "n", "anchor", "score", "predicted", "held_out", "row", "word", "fates", "fate_of", "gone", "_id", "_key", "w", "h", "lang_pred", "labels", "spans", "item_id", "component_id", "links", "n_words", "y", "place"]


@pytest.fixture(autouse=True)
def one_pass(monkeypatch):
    monkeypatch.setattr(brown, "PASSES", 1)


@pytest.fixture(scope="module")
def table(spark):
    cols = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(d, t, "en", *["?"] * len(CLASH)) for d, t in ROWS], f"doc_id long, text string, lang string, {cols}")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d, int(d % 2), int(d == 6), "?", "?") for d, _ in ROWS if d is not None] + [(None, 1, 1, "?", "?"), (4, None, None, "?", "?"), (777, 1, 0, "?", "?")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SAME, "?"), (2, None, "?"), (3, "", "?")], "item_id long, text string, doc_id string")


def operators(docs, labels, items):
    rank = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    return {
        "decontaminate": lambda: decontaminate.search(docs, items),
        "brown": lambda: brown.score_documents(docs),
        "bpe": lambda: bpe.digests(docs, *rank),
        "langid": lambda: langid.identify_documents(docs),
        "license": lambda: setjoin.license_labels(docs),
        "license_wrapped": lambda: setjoin.license_labels(docs, wrapped=True),
        "toxicity": lambda: toxicity.score_documents(docs, labels),
        "near": lambda: nearjoin.classify(docs),
        "substring": lambda: substring.digests(docs),
        "quality": lambda: quality.score_documents(docs, labels),
        "media": lambda: media.stored_texts(docs),
        "keep_good": lambda: quality.keep_good(docs, quality.fit_fold(docs, labels)[0]),
        "one_of_each": lambda: nearjoin.one_of_each(docs),
        "remove": lambda: substring.remove(docs),
        "clean": lambda: decontaminate.clean(docs, items),
    }


PER_ROW = ["brown", "bpe", "langid", "license", "license_wrapped", "toxicity", "near", "substring", "quality", "media"]
FILTERS = ["keep_good", "one_of_each", "remove", "clean"]


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_a_row_and_equal_rows_alike(table, labels, items, name):
    rows = operators(table, labels, items)[name]().collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ROWS)
    twice = [r for r in rows if r.doc_id == 4]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", PER_ROW + FILTERS + ["decontaminate"])
def test_empty_table(table, labels, items, name):
    assert operators(table.limit(0), labels, items)[name]().count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_and_values(table, labels, items, name):
    out = operators(table, labels, items)[name]()
    assert out.dtypes == table.dtypes
    rows = out.collect()
    assert all(r[c] == "?" for r in rows for c in CLASH) and all(r.lang == "en" for r in rows)
    left = {str(r.doc_id) for r in rows}
    if name != "keep_good":
        assert {"1", "2", "3", "8", "9", "7"} <= left  # texts that share nothing stay, null and empty ones too
        assert "5" not in left  # a copy of a smaller id, or a benchmark item
    if name in ("one_of_each", "remove"):
        assert "None" in left and "4" in left
        assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    if name == "remove":
        assert [r.text for r in rows if r.doc_id == 6] == ["idiot"]


def test_decontamination_of_edge_rows(table, items):
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.search(table, items).collect())
    assert got == [("4", 1), ("5", 1), ("6", 1), ("None", 1)]


def test_every_stage_takes_edge_rows(spark, table, labels, items, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = str(tmp_path)
    table.withColumn("n_chars", table.doc_id).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "encoding":
            assert out.columns == docs.columns and {"1", "2", "8"} <= {str(r.doc_id) for r in out.collect()} | ({"1", "2", "8"} if name == "quality" else set())


# scores by plain versions


def test_language_scores_equal_a_plain_version(spark):
    texts = {"el": ["καλημερα κοσμε ελα", "το σπιτι ειναι μεγαλο"], "ru": ["доброе утро мир", "дом очень большой"], "uk": ["доброго ранку світе їжак", "будинок дуже великий ґанок"], "zh": ["你好世界 大家好", "房子很大"]}
    rows = [(100 + i, t, lang) for i, (lang, t) in enumerate((k, x) for k, v in texts.items() for x in v * 4)]
    rows += [(500, "світе їжак", None), (501, "你好世界", None), (502, "утро мир", "uk"), (503, "𐐀𐐁 x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}

    def vector(c):
        return np.ones(langid.DIM) * langid.letter_vectors(np.array([c]))[0]

    def plain(text):
        s = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
        s = [0, *s, 0]
        s = [c for i, c in enumerate(s) if c or i == 0 or s[i - 1]]
        total = np.zeros(langid.DIM)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return total

    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in rows}
    proto = {}
    for d, t, lang in rows:
        if lang and not held[d]:
            proto[lang] = proto.get(lang, 0) + plain(t)
    for d, t, _ in rows:
        v = plain(t)
        cos = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in proto.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[d].lang_pred == best and got[d].score == pytest.approx(max(0, cos[best]), abs=1e-5) and got[d].held_out == held[d]
    assert got[500].lang_pred == "uk" and got[501].lang_pred == "zh"


def test_language_profiles_that_overflow_give_the_same(monkeypatch):
    text = " ".join(chr(0x4E00 + i) + chr(0x4E00 + i * 7 % 500) for i in range(900))
    g, n = langid.gram_counts(text)
    whole = langid.bundle(langid.Profiles(), g, n)
    monkeypatch.setattr(langid, "CACHE", 50)
    p = langid.Profiles()
    langid.bundle(p, g[:40], n[:40])
    assert np.allclose(langid.bundle(p, g, n), whole) and np.allclose(langid.bundle(p, g[30:60], n[30:60]) + langid.bundle(p, g[60:90], n[60:90]), langid.bundle(langid.Profiles(), g[30:90], n[30:90]))


def test_toxicity_scores_equal_enumeration(spark):
    rnd = np.random.default_rng(8)
    field = toxicity.Field(rnd.normal(0, 0.7, (1 << toxicity.BITS) + 2), rnd.normal(0, 1, (2, 2)))
    texts = ["you idiot", "a b c d e f", "one", "", None, "Same same SAME", "x, y; z!"]
    got = {r.k: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), field, {"k": "bigint"}).collect()}
    for k, t in enumerate(texts):
        w = toxicity._tokens(pa.array([t], pa.string()))
        f = toxicity.features(w)
        emit = [sum(field.weights[i] for i in f[:, j]) for j in range(len(w))]
        total, on = 0.0, np.zeros(len(w))
        for s in itertools.product((0, 1), repeat=len(w)):
            x = math.exp(sum(e for e, v in zip(emit, s, strict=True) if v) + sum(field.trans[a, b] for a, b in zip(s, s[1:], strict=False)))
            total, on = total + x, on + x * np.array(s)
        p = on / total
        want = max(p) if len(w) else 0.0
        assert got[k].score == pytest.approx(want, rel=1e-6) and got[k].predicted == int(want >= 0.5)
        assert [s.p for s in got[k].spans] == pytest.approx([x for x in p if x >= 0.5])
        raw = (t or "").encode()
        assert [raw[s.start : s.end].decode() for s in got[k].spans] == [s.text for s in got[k].spans]


def test_quality_scores_equal_a_plain_version(spark):
    rnd = np.random.default_rng(9)
    n, h = quality.FEATURES, quality.HIDDEN
    net = quality.Net(rnd.normal(0, 0.1, n), rnd.uniform(0.5, 1, n), rnd.normal(0, 1, (n, h)), rnd.normal(0, 1, (n, h)), rnd.normal(0, 1, h), rnd.normal(0, 1, n), 0.2, np.where(rnd.random(quality.WORDS) < 0.5, np.nan, rnd.normal(0, 1, quality.WORDS)).astype(np.float32))
    texts = [None, "", "one two", " ".join(f"w{i % 70}!" for i in range(260)), "A $$ | b"]
    got = {r.k: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), net, {"k": "bigint"}).collect()}
    for k, t in enumerate(texts):
        words = brute.words(t)
        parts = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
        x, at = quality.passages(pa.array([t], pa.string()), net.odds)
        assert at.tolist() == [0, len(parts)]
        for row, part in zip(x, parts, strict=True):
            odds = [float(net.odds[quality._groups(textkit.words(pa.array([w]), False))[0]]) for w in part]
            known = [0.0 if math.isnan(o) else o for o in odds]
            size = max(1, len(part))
            text = t[t.find(part[0]) :] if part else ""
            assert row[-3:] == pytest.approx([sum(known) / size, sum(min(0, o) for o in known) / size, sum(not math.isnan(o) for o in odds) / size], abs=1e-6)
            assert row[len(quality.CLASSES) + 5] == pytest.approx(len(part) / quality.PASSAGE) and (not part or text)
        e, hid = [], [(r - net.mean) / net.scale for r in x]
        for v in hid:
            e.append(sum(net.w[j] * math.tanh(float(v @ net.V[:, j])) / (1 + math.exp(-float(v @ net.U[:, j]))) for j in range(h)))
        a = [math.exp(q - max(e)) for q in e]
        z = sum(q / sum(a) * v for q, v in zip(a, hid, strict=True))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-float(z @ net.c) - net.b)), rel=1e-6)
        assert list(got[k].attention) == pytest.approx([q / sum(a) for q in a], abs=1e-5)


def test_word_odds_equal_counts():
    texts, good = pa.array(["a b", "a c a", "a d", "d", None]), np.array([1, 1, 0, 0, 1])
    odds = quality.word_odds(texts, good)
    of = lambda w: float(odds[quality._groups(textkit.words(pa.array([w]), False))[0]])
    assert of("a") == pytest.approx(math.log(2.5 / 4) - math.log(1.5 / 3), abs=1e-6) and of("d") == pytest.approx(math.log(0.5 / 4) - math.log(2.5 / 3), abs=1e-6) and math.isnan(of("b"))


def test_labelled_sample_takes_long_texts(spark):
    rows = [(i, LONG[: 40_000 if i % 3 else 200_000]) for i in range(12)] + [(3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, y int")
    texts, n = textkit.labelled_sample(docs, marks, "y", 100, 10 << 20)
    assert n == [6, 6] and [len(t) for t in texts] == [6, 6] and sorted(len(x) for t in texts for x in t.to_pylist())[-1] == 200_000
    few, _ = textkit.labelled_sample(docs, marks, "y", 100, 300_000)
    assert all(sum(len(x) for x in t.to_pylist()) <= 300_000 and len(t) >= 2 for t in few) and max(len(x) for t in few for x in t.to_pylist()) == 200_000


def test_stored_texts_equal_a_container_written_by_hand(spark):
    """Payload, feature and every key frame, from the bytes of the container itself."""
    import hashlib

    text = "é" * 1000 + "tail"
    (r,) = media.stored_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    raw = text.encode()
    payload = raw + b"\0" * (-len(raw) % 64)
    blob = media.wrap(payload)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    at = blob.index(payload)
    frames = len(payload) // 64
    keys = [(k.start, k.length) for k in r.keyframes]
    assert all(s >= at and (s - at) % 64 == 0 and n == 64 for s, n in keys) and keys[0][0] == at and len(set(keys)) == len(keys)
    ranges = zlib.crc32(b"".join(s.to_bytes(8, "big") for s, _ in keys) + b"".join(n.to_bytes(8, "big") for _, n in keys))
    (track,), _ = media.inspect(blob)
    assert r.feature == f"codec=raw;duration={track.duration}/{track.timescale};samples={frames};keyframes={len(keys)};ranges={ranges:08x}"
    # box sizes and names walk the whole file
    names, k = [], 0
    while k < len(blob):
        size = int.from_bytes(blob[k : k + 4], "big")
        names.append(blob[k + 4 : k + 8])
        k += size
    assert k == len(blob) and b"moov" in names and b"mdat" in names
