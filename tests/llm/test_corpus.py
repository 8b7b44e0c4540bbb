import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import brown, components, decontaminate, fmindex, langid, nearjoin, quality, setjoin, substring, textkit, toxicity

from . import brute

RND = random.Random(17)
VOCAB = ["the", "of", "And", "éa", "x1", "b,", "c.", "delta", "fox", "gnu", "hat", "ink", "jar"]


def text(n):
    return " ".join(RND.choice(VOCAB) + RND.choice(["", str(RND.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [text(n) for n in (30, 60, 90, 200, 14, 3, 400)]
    out = [(i, t) for i, t in enumerate(base)]
    passage = text(25)
    for i in range(60):
        b = base[i % len(base)].split()
        for _ in range(RND.choice([0, 1, 2, 5])):
            b[RND.randrange(len(b))] = f"new{i}"
        out.append((100 + i, " ".join(b)))
        out.append((200 + i, f"{text(9)} {passage}\n{text(RND.randrange(30))}"))
    out += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "one two three"), (906, "x " * 5000), (907, "y " * 70000)]
    RND.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns with the names that operators use themselves."""
    extra = ("n", "score", 7, "w")
    return spark.createDataFrame([(d, t, *extra) for d, t in rows], "doc_id long, text string, key string, predicted string, seq int, word string")


def test_word_and_gram_hashes(rows):
    texts = pa.array([t for _, t in rows], pa.string())
    w = textkit.words(texts)
    got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    want = [x for _, t in rows for x in brute.words((t or "").translate(brute.FOLD))]
    assert got == want
    assert len(set(zip(want, w.hash.tolist(), strict=True))) == len(set(want)) == len(set(w.hash.tolist()))
    parts = list(textkit.slices(pa.record_batch([texts], ["text"])))
    assert sum(p.num_rows for p in parts) == len(rows)
    assert np.concatenate([textkit.words(p.column(0)).hash for p in parts]).tolist() == w.hash.tolist()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (7, None), (30, 20)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20, 30: 20}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_near_join_equals_brute_force(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(nearjoin, "CHUNK", chunk)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.classify(docs).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize(("chunk", "sets"), [(8 << 20, 1 << 13), (2000, 1 << 13), (8 << 20, 7)])
def test_near_join_counts_every_link(spark, docs, rows, chunk, sets, monkeypatch):
    """A text that drifts a word at a time, with copies: neighbours link, distant versions only through others."""
    monkeypatch.setattr(nearjoin, "CHUNK", chunk)
    monkeypatch.setattr(nearjoin, "SETS", sets)
    w, drift = [f"u{i}" for i in range(90)], []
    for i in range(45):
        w[(i * 37) % 90] = f"v{i}"
        drift += [(900_000 + 3 * i + k, " ".join(w)) for k in range(1 + i % 3)]
    rows = [*rows, *drift]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(drift, "doc_id long, text string"))
    of = {d: {tuple(x[i : i + 4]) for i in range(max(1, len(x) - 3))} if x else set() for d, x in ((d, brute.words((t or "").translate(brute.FOLD))) for d, t in rows)}
    want = {d: sum(e != d and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for e, y in of.items()) for d, x in of.items()}
    got = nearjoin.classify(df).collect()
    assert {r.doc_id: r.links for r in got} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)


def test_all_links_equal_pairs_over_many_leaves():
    rnd = np.random.default_rng(8)
    sets = []
    for n in (7, 40, 300):
        base = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        sets += [np.unique(np.append(rnd.permutation(base)[rnd.integers(0, max(2, n // 9)) :], rnd.integers(0, 2**63, rnd.integers(0, 3), dtype=np.uint64))) for _ in range(150)]
    sets = [sets[i] for i in rnd.permutation(len(sets))]
    copies = rnd.integers(1, 4, len(sets))
    link = np.array([[i != j and nearjoin.linked(x, y, 85) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    for k in (len(sets), 130):
        inside = link.copy()
        if k < len(sets):
            inside[:k, :k] = inside[k:, k:] = False
        count, edges = nearjoin.all_links(sets[:k], sets[k:] or None, copies, 85)
        assert count.tolist() == (inside @ copies).tolist()
        cls, want = nearjoin.Classes(np.arange(len(sets))), nearjoin.Classes(np.arange(len(sets)))
        for c, pairs in ((cls, edges), (want, np.argwhere(inside).tolist())):
            for i, j in pairs:
                if c.label[i] != c.label[j]:
                    c.join(i, j)
        assert sorted(map(sorted, cls.members.values())) == sorted(map(sorted, want.members.values()))
        assert len(edges) == len(sets) - len(cls.members)


@pytest.mark.parametrize("batch", [1, 2, 5])
def test_candidates_keep_the_tail_of_a_hot_key(batch, monkeypatch):
    monkeypatch.setattr(nearjoin, "MEET", 3)
    sizes = nearjoin.classes(85)
    base = np.arange(1, 41, dtype=np.uint64)
    groups = {7 << 6: list(range(10)), 8 << 6: [20, 21], 9 << 6: [30, 31, 32, 33, 34]}
    k = next(i for i, (least, top, *_) in enumerate(sizes) if least <= 40 <= top)
    sig = nearjoin.signature(base, sizes)
    rows = [(key | k, fp, sig) for key, fps in groups.items() for fp in fps]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "fp", "sig"), r, strict=True)) for r in rows[i : i + batch]]) for i in range(0, len(rows), batch)]
    edges = [(a, b) for out in nearjoin._candidates(sizes, 85)(batches) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"), strict=True)]
    cls = nearjoin.Classes(np.arange(40))
    for a, b in edges:
        if cls.label[a] != cls.label[b]:
            cls.join(a, b)
    assert all(len({int(cls.label[x]) for x in fps}) == 1 for fps in groups.values())


def test_near_join_with_hot_parts_equals_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(nearjoin, "MEET", 3)
    of = textkit.batches_of
    monkeypatch.setattr(textkit, "batches_of", lambda spark, _: of(spark, 2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.classify(docs).collect()}
    assert got == brute.near(rows)


def test_near_join_of_repeated_and_null_ids(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (9, "a b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in nearjoin.classify(df).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", None)]
    assert nearjoin.classify(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in nearjoin.one_of_each(df).collect()) == ["3", "9", "None"]


def test_part_keys_always_meet():
    sizes, rnd = nearjoin.classes(85), np.random.default_rng(3)
    for n in (6, 7, 9, 20, 47, 150, 900):
        for _ in range(20):
            x = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            drop = rnd.integers(0, int(0.15 * n) + 1)
            y = np.sort(rnd.permutation(x)[drop:])
            if nearjoin.linked(x, y, 85) and len(x) != len(y):
                assert set(nearjoin.part_keys(x, sizes).tolist()) & set(nearjoin.part_keys(y, sizes).tolist())


@pytest.mark.parametrize("hot,shard,keys", [(1000, 2 << 20, 1000), (3, 300, 20)])
def test_substring_equals_brute_force(docs, rows, hot, shard, keys, monkeypatch):
    """Small limits make anchors wide, shards many and copies hot."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", shard)
    monkeypatch.setattr(textkit, "HOT_KEYS", keys)
    found = substring.digests(docs).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found}
    want = brute.kept_words(rows)
    assert got == {d: (len(w), len(w) - len(k), brute.sha(k)) for d, (w, k) in want.items()}
    for r in found:
        words, kept = want[r.doc_id]
        gone = {i for s in r.removed for i in range(s.start, s.end)}
        assert [x for i, x in enumerate(words) if i not in gone] == kept
    kept = {r.doc_id: r.text for r in substring.remove(docs).collect()}
    source = dict(rows)
    assert kept == {d: source[d] if len(w) == len(k) else " ".join(k) for d, (w, k) in want.items() if k or not w}
    assert substring.remove(docs).columns == docs.columns


def test_substring_of_repeated_and_null_ids(spark):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(5, t), (5, t), (7, "z " + t), (7, "other"), (None, t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.digests(df).collect())
    assert got == [("5", 20, 0), ("5", 20, 0), ("7", 1, 0), ("7", 21, 20), ("None", 20, 0)]
    assert substring.digests(df.limit(0)).count() == 0


def colliding_words(bits=32, n=400_000):
    """Pairs of unlike words whose hashes agree in their upper half."""
    names = [f"n{i}" for i in range(n)]
    h = textkit.words(pa.array([" ".join(names)]), False).hash >> np.uint64(64 - bits)
    order = np.argsort(h)
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    return [(names[order[i]], names[order[i + 1]]) for i in same.tolist()]


def test_substring_tells_words_apart_whose_hashes_agree_in_part(spark):
    pairs = colliding_words()
    assert len(pairs) >= 13
    one, two = ([p[k] for p in pairs[:13]] for k in (0, 1))
    tail = "a b c d e f g h i j k".split()
    rows = [(i, " ".join([*x, *tail])) for i, x in enumerate((one, two))]
    got = {r.doc_id: r.n_removed for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: len(w) - len(k) for d, (w, k) in brute.kept_words(rows).items()} == {0: 0, 1: 0}


def test_hashes_do_not_depend_on_how_a_text_is_cut(rows, monkeypatch):
    texts = pa.array([t for _, t in rows], pa.string())
    w = textkit.words(texts)
    h, g, s = w.hash, textkit.grams(w.hash, 4), textkit.sequence_ids(w)
    monkeypatch.setattr(textkit, "SLICE_BYTES", 100)
    w = textkit.words(texts)
    assert (w.hash == h).all() and (textkit.grams(h, 4) == g).all() and (textkit.sequence_ids(w) == s).all()


def test_summary_keeps_common_numbers(monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT", 16)
    rnd, common, all_ = np.random.default_rng(4), substring.Summary(), []
    for _ in range(20):
        x = np.concatenate([np.full(30, 7), rnd.integers(0, 10_000, 100)])
        common.add(x)
        all_ += x.tolist()
    n = dict(zip(common.number.tolist(), common.count.tolist(), strict=True))
    assert len(n) <= 16 and common.total == len(all_) and all_.count(7) - len(all_) / 16 <= n[7] <= all_.count(7)


def test_join_by_hot_keys_equals_a_plain_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)] + [(999, None)], "x long, k long")
    per = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k + 1 AS y")
    want = sorted(map(tuple, rows.join(per.drop("n"), "k").collect()))
    for keys in (1, 10, 1000):
        monkeypatch.setattr(textkit, "HOT_KEYS", keys)
        assert sorted(map(tuple, textkit.joined_by(rows, per, "k").collect())) == want


def test_fm_index_counts():
    rnd = np.random.default_rng(1)
    seqs = [rnd.integers(0, 4, rnd.integers(5, 40)) for _ in range(50)]
    fm = fmindex.FMIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), 8)
    for length in (1, 3, 8):
        pats = np.stack([s[:length] for s in seqs if len(s) >= length] + [np.array([0, 1, 2, 3, 3, 2, 1, 0])[:length]])
        lo, hi = fm.intervals(pats)
        for p, n in zip(pats, hi - lo, strict=True):
            assert n == sum((s[i : i + length] == p).all() for s in seqs for i in range(len(s) - length + 1))


def test_matching_statistics_equal_brute_force():
    rnd = np.random.default_rng(2)
    seqs = [rnd.integers(0, 3, rnd.integers(8, 30)) for _ in range(40)]
    value = rnd.integers(0, 12, 40)
    size = np.array([len(s) for s in seqs])
    stream, doc = np.concatenate(seqs), np.repeat(np.arange(40), size)
    within = np.arange(len(stream)) - np.repeat(np.cumsum(size) - size, size)
    ends = np.flatnonzero(within >= 5)
    got = fmindex.FMIndex(stream, size, 6).matching_statistics(stream, ends, value, value[doc[ends]])
    for e, n in zip(ends.tolist(), got.tolist(), strict=True):
        below = [s.tolist() for s, v in zip(seqs, value, strict=True) if v < value[doc[e]]]
        fits = [k for k in range(1, 7) if any(stream[e - k + 1 : e + 1].tolist() == s[i : i + k] for s in below for i in range(len(s)))]
        assert n == max(fits, default=0)


def test_range_minimum():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        x = rnd.integers(0, 50, n)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
        lo, hi = map(np.array, zip(*pairs, strict=True))
        assert fmindex.RangeMinimum(x).least(lo, hi).tolist() == [x[a:b].min() for a, b in pairs]


def test_decontamination_equals_brute_force(spark, docs, rows):
    source = dict(rows)
    items = [(1, source[3][:300]), (2, "unseen words here that no document has at all"), (3, "ONE, two"), (4, None), (5, ""), (6, source[210]), (7, source[3][:300]), (8, "gnu")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained(rows, items)
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.search(docs, b).collect()}
    assert got == want and len(want) > 5
    assert {r.doc_id for r in decontaminate.clean(docs, b).collect()} == set(source) - {d for d, _ in want}
    assert decontaminate.search(docs, b.limit(0)).count() == 0 and decontaminate.search(docs.limit(0), b).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Some text.\nReleased under the MIT License."), (2, None), (3, ""), (4, "CC BY cc by\nApache License"), (5, "licensed under CC BY-NC 4.0."),
        (6, "released under MIT license, today"), (6, "the mit the license"), (None, "GNU GENERAL public license"), (7, "plain words only"),
        (8, "x\n" * 3000 + "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = sorted(map(tuple, setjoin.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    by = {(r[0], r[1]): r[2:] for r in got}
    assert len(got) == len(rows)
    assert by[1, 7] == (1, 5, 6 - 1, "mit", "mit,mit-notice", 1.0)
    assert by[2, 0] == by[3, 0] == (0, None, None, "", "", 0.0)
    assert by[4, 6] == (3, 0, 4, "apache,cc-by", "apache,cc-by", 1.0)
    assert by[5, 7][3:] == ("cc-by", "cc-by,cc-by-4.0,cc-by-nc-4.0,cc-by-sa-4.0", 1.0)
    assert by[6, 5][4] == "mit,mit-notice" and by[6, 4] == (0, None, None, "", "", 0.0)
    assert by[None, 4] == (1, 0, 0, "gpl", "gpl", 1.0)
    assert by[8, 3012][0] == 1 and "gpl-3.0" in by[8, 3012][4]
    for d, x in rows:
        w = brute.license_words(x)
        assert any(k[0] == d and k[1] == len(w) for k in by)


def test_wrapped_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    filler = "some other words " * 50
    rows = [(1, bsd), (2, filler + "\n * ".join(bsd.split()) + "\n" + filler), (3, bsd.replace("\n", "\n" + "some other words\n" * 50)), (4, None), (5, "licensed\nunder\nCC BY\n4.0"), (6, "released under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in setjoin.license_labels(df, wrapped=True).collect()}
    assert "bsd" in got[1] and "bsd" in got[2] and got[3] == "" and got[4] == "" and "cc-by-4.0" in got[5] and "mit-notice" in got[6]


def test_wrapped_licenses_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op5_license_wrapped"]).fetchall()
    got = list(map(tuple, queries.QUERIES["op5_license_wrapped"](spark, "/root/testdata/sf0.001").collect()))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("lookup", [1 << 19, 5])
def test_brown_base_score_and_distribution(spark, rows, docs, lookup, monkeypatch):
    monkeypatch.setattr(brown, "LOOKUP", lookup)
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = brute.token_counts([t for d, t in rows if not held[d]])
    total, types = sum(c.values()), len(c)
    got = {r.doc_id: r for r in brown.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        tokens = [*brute.words((t or "").translate(brute.FOLD)), None]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens), sum(c[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in tokens), rel=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_brown_classes_do_not_depend_on_the_lookup(spark, monkeypatch):
    """Words beyond the table stand beside each other; their classes and pairs come by joins and must be the same."""
    rnd, texts = random.Random(9), []
    for i in range(500):
        side = i % 2
        t = [f"{'ab'[side]}{rnd.randrange(270)}w" for _ in range(60)]
        for k in range(3, 57, 6):
            t[k], t[k + 1] = (f"q{'xy'[side]}{s}{rnd.randrange(60)}zz" for s in "mn")
        texts.append(" ".join(t))
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    models = []
    for lookup in (1 << 19, brown.HEAD):
        monkeypatch.setattr(brown, "LOOKUP", lookup)
        models.append(brown.fit(df))
    assert len(models[0].known) > len(models[1].known)
    of = [{r["word"]: (r["n"], r["class"]) for r in m.counts.collect()} for m in models]
    assert of[0] == of[1]
    end, pairs = brown.CLASSES - 1, np.zeros((brown.CLASSES, brown.CLASSES))
    for x in texts:
        c = [end, *(of[1][h][1] for h in textkit.words(pa.array([x])).hash.view(np.int64).tolist()), end]
        np.add.at(pairs, (c[:-1], c[1:]), 1)
    for m in models:
        assert np.allclose(m.transition, np.log10((pairs + brown.A) / (pairs.sum(1, keepdims=True) + brown.A * brown.CLASSES)), atol=1e-12)


def test_brown_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = brown.fit(df.limit(0))
    assert model.tokens == 0 and np.allclose((10**model.transition).sum(1), 1)
    assert sorted(r.n_known for r in brown.score(df.selectExpr("doc_id", "text"), model, {"doc_id": "bigint"}).collect()) == [0, 0]


@pytest.mark.parametrize("lookup", [1 << 19, 560])
def test_brown_classes_of_rare_words_follow_contexts(spark, lookup, monkeypatch):
    """Two languages of 280 frequent words each; 80 rarer words of each are spelled alike."""
    monkeypatch.setattr(brown, "LOOKUP", lookup)
    rnd, texts, tails = random.Random(5), [], ([], [])
    for side in (0, 1):
        for i in range(80):
            tails[side].append(f"q{'xy'[side]}{i}zz")
        for _ in range(600):
            t = [f"{'ab'[side]}{rnd.randrange(280)}w" for _ in range(60)]
            for k in range(5, 60, 9):
                t[k] = rnd.choice(tails[side])
            texts.append(" ".join(t))
    model = brown.fit(spark.createDataFrame([(x,) for x in texts], "text string"))
    hashes = [textkit.words(pa.array([" ".join(t)])).hash.view(np.int64).tolist() for t in tails]
    of = {r["word"]: r["class"] for r in model.counts.collect()}
    a, b = ([of[h] for h in hs] for hs in hashes)
    apart = sum(x not in set(b) for x in a) + sum(x not in set(a) for x in b)
    assert apart >= 150
    # the score is that of the model's classes, whether a word's class is broadcast or joined
    x = texts[0] + " unseen " + texts[-1]
    w = textkit.words(pa.array([x]))
    n = {r["word"]: r["n"] for r in model.counts.collect()}
    c = [of.get(h, int(model.of_bucket[k])) for h, k in zip(w.hash.view(np.int64).tolist(), brown._bucket(w).tolist(), strict=True)] + [brown.CLASSES - 1]
    logs = [math.log10(n.get(h, 0) + 0.1) for h in w.hash.view(np.int64).tolist()] + [math.log10(model.ends + 0.1)]
    want = sum(logs) + sum(model.transition[p, q] - model.spread[q] for p, q in zip([brown.CLASSES - 1, *c[:-1]], c, strict=True))
    (got,) = brown.score(spark.createDataFrame([(1, x)], "doc_id long, text string"), model, {"doc_id": "bigint"}).collect()
    assert got.score == pytest.approx(want, rel=1e-9)


def test_exchange_separates_two_languages():
    b = np.zeros((9, 9))
    b[:4, :4], b[4:8, 4:8] = 50, 50
    b[8, :8], b[:8, 8] = 1, 1
    of = brown.exchange(b, 3)
    assert len(set(of[:4].tolist())) == 1 and len(set(of[4:8].tolist())) == 1 and of[0] != of[4] and of[8] == 2


def test_language_id(spark):
    a = ["the cat sat on the mat and the dog", "where there is the other thing", "that is the weather then"]
    b = ["der hund und die katze sind schön", "über die straße gehen und zurück", "ich weiß nicht warum die leute"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(x, "en") for x in a * 6] + [(x, "de") for x in b * 6])]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "die katze und der hund", None), (None, "the mat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:36]) and got[103].lang_pred == "de"
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(36)) and got[None].held_out is False
    assert {r.lang_pred for r in langid.identify_documents(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


def test_marginals_equal_enumeration():
    import itertools

    rnd = np.random.default_rng(5)
    emit, trans = rnd.normal(0, 1.5, 700), rnd.normal(0, 1, (2, 2))
    first = np.zeros(700, bool)
    first[[0, 5, 6, 12]] = True
    p = toxicity.marginals(emit, first, trans)[0]
    for lo, hi in ((0, 5), (5, 6), (6, 12)):
        total, on = 0.0, np.zeros(hi - lo)
        for s in itertools.product((0, 1), repeat=hi - lo):
            x = math.exp(sum(emit[lo + i] for i, v in enumerate(s) if v) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
            total += x
            on += x * np.array(s)
        assert np.allclose(p[lo:hi], on / total)


def test_marginals_in_parts_equal_the_whole(monkeypatch):
    rnd = np.random.default_rng(6)
    emit, trans, first = rnd.normal(0, 1.5, 5000), rnd.normal(0, 1, (2, 2)), rnd.random(5000) < 0.01
    first[0] = True
    whole = toxicity.marginals(emit, first, trans)
    monkeypatch.setattr(toxicity, "AT_ONCE", 300)
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(whole, toxicity.marginals(emit, first, trans), strict=True))


def test_toxicity_sample_is_not_lowered():
    assert toxicity.SAMPLE == 2000 and toxicity.CLEAN_COST == 3


def labelled(spark, kind):
    rows, labels = [], []
    for i in range(240):
        good = " ".join(f"word{RND.randrange(90)}" for _ in range(RND.randrange(5, 120)))
        bad = i % 4 == 0
        if kind == "toxic":
            t = good.split()
            if bad:
                t.insert(RND.randrange(len(t)), RND.choice(["idiot", "scum", "moron"]))
            t = " ".join(t)
        else:
            t = " ".join(f"{w}$$$" for w in good.split()) if bad else good
        rows.append((i, t))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(900, None), (901, ""), (None, "null id"), (5, "again five")]
    labels += [(5, None), (None, 1), (7777, 1), (6, labels[6][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels[:240]), len(rows)


def test_toxicity_held_out(spark):
    docs, labels, truth, n = labelled(spark, "toxic")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == n
    wrong = [r.doc_id for r in got if r.doc_id in truth and r.doc_id != 5 and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    spans = {s.text for r in got for s in r.spans}
    assert spans <= {"idiot", "scum", "moron"} and spans
    assert all(r.score == 0 for r in got if r.doc_id in (900, 901))
    assert {r.predicted for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0}


def test_quality_held_out(spark):
    docs, labels, truth, n = labelled(spark, "quality")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == n
    wrong = [r.doc_id for r in got if r.doc_id in truth and r.doc_id != 5 and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and abs(sum(r.attention) - 1) < 1e-4 for r in got)
    assert {round(r.score, 6) for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path, rows):
    import hashlib

    import corpus_pipeline

    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows if d < 900]
    docs += [(2000 + i, f"clean start {i} " + text(40), "en", "s", 1) for i in range(20)]
    docs += [(3000 + i, " ".join(f"{w}$$$" for w in text(30).split()), "en", "s", 1) for i in range(30)]
    labels = [(d, int(d < 3000), 0) for d, *_ in docs]
    bench = [(1, docs[-45][1]), (2, "not there at all " * 3)]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", bench, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "encoding"]
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    left = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"] and not [d for d in left if d >= 3000] and len(left) >= len(docs) - 32
    left = {d: left[d] for d, (_, c) in brute.near(left.items(), 5, 80).items() if c == d}
    left = {d: left[d] if len(w) == len(k) else " ".join(k) for d, (w, k) in brute.kept_words(left.items()).items() if k or not w}
    gone = {d for d, _ in brute.contained(left.items(), bench)}
    ids = {}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=__import__("tidemark.llm.bpe", fromlist=["bpe"]).Vocabulary.read(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    for d, t in left.items():
        if d not in gone:
            x = lib.encode_ordinary(t)
            ids[d] = (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == ids and gone


def test_toxicity_fit_takes_bounded_memory_a_token():
    """Keys and features of the sample's tokens are not held together, nor are the steps of all tokens at once."""
    import tracemalloc

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["vile", "w1"]) if i % 2 and k % 50 == 9 else f"w{rnd.randrange(3000)}" for k in range(1500)) for i in range(400)]
    col = pa.array(texts, pa.large_string())
    tracemalloc.start()
    try:
        field = toxicity.train(col, np.arange(400) % 2 == 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert field.weights.any()
    assert peak < 200 * 600_000


def test_brown_contexts_take_bounded_memory_a_word():
    import tracemalloc

    n, rnd = 400_000, np.random.default_rng(2)
    word, own = rnd.integers(0, 2**63, n // 2, dtype=np.uint64)[rnd.integers(0, n // 2, n)], np.zeros(n, np.int8)
    right, left = (rnd.integers(-1, brown.CLASSES, n).astype(np.int8) for _ in range(2))
    tracemalloc.start()
    try:
        words, _, near = brown.packed(word, own, right, left)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == len(np.unique(word)) and sum(sum(x[1::2]) for x in near.to_pylist()) == (right >= 0).sum() + (left >= 0).sum()
    assert peak < 130 * n


def test_trim_gives_back_what_arrow_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    list(textkit.releasing(iter)([1]))
    assert calls
