"""Substring deduplication with sharded FM-indexes.

A window is ``length`` consecutive words.  A word goes when a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

1. Texts with equal word sequences are one text, owned by its smallest id; of another
   copy every word goes (if it has a window at all).
2. Every window has an *anchor*: the smallest hash of its ``GRAM``-word grams (the
   leftmost of equals).  It depends on the window's words only, so equal windows have
   equal anchors, and about four neighbouring windows share one.  Anchors of two or
   more texts may repeat windows; windows of all other anchors are done.
3. Neighbouring windows of one such anchor are one segment, which carries its words.
   Equal segments become one (with the smallest id), and segments are dealt to shards by
   anchor, so equal windows meet in one shard.  An anchor of more than ``HOT`` texts, such
   as one in a line that a third of all documents hold, would be one large shard: its
   windows are segments of their own, dealt by the window's hash.
4. A shard builds an FM-index (wavelet matrix over the last column of its sorted
   suffixes) of at most ``SHARD`` bytes of words and one more anchor's.  All its segments
   stream through backward search, word by word: the matching statistics say how many
   words up to each place stand together in a segment of a smaller id.  Where they reach
   ``length``, the window is repeated; such windows side by side are one interval.
5. The intervals return to every text that holds the segment (a text that is not its
   owner loses all of it), and a text drops the words under them.

The first pass over the texts also counts the commonest anchors of each task by a
summary of ``FREQUENT`` counters, so that the rows of an anchor which holds more than its
share are dealt over many tasks; texts and segments with very many copies are joined by
a broadcast of at most ``textkit.HOT_KEYS`` rows.

Words, anchors and segments are compared by 64-bit hashes.

Defined results: a null or empty text has no words and stays as it is; a text shorter
than a window keeps all words; rows with equal ids are never smaller than each other;
repeated rows each give a row; rows with a null id keep all words and remove none; an
empty table gives an empty result; other columns keep their values, whatever their names.
A text of any length is read whole; its arrays take about 100 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .fmindex import FMIndex
from .textkit import U64

LENGTH = 13
GRAM = 6
HOT = 1000
#: Bytes of words of one index.
SHARD = 2 << 20
#: Counters of a task's summary of common anchors, and tasks that an anchor above its share is dealt to.
FREQUENT = 1024
DEAL = 64


def anchors(w: textkit.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside one document: their first word, anchor hash and anchor place (word numbers of the batch)."""
    g = textkit.grams(w.hash, gram)
    span = length - gram + 1
    n = len(w) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z.view(U64), z
    least, have = g, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    least = least[:n]
    place = np.zeros(n, np.int64)
    for k in range(span - 1, -1, -1):
        place[g[k : k + n] == least] = k
    at = np.flatnonzero(w.doc[:n] == w.doc[length - 1 :])
    return at, least[at], at + place[at]


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))


class Summary:
    """Counts of the commonest numbers of a stream, each too low by at most 1 / ``FREQUENT`` of the stream."""

    def __init__(self):
        self.number, self.count, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, numbers: np.ndarray) -> None:
        both, back = np.unique(np.concatenate([self.number, numbers]), return_inverse=True)
        count = np.bincount(back, np.concatenate([self.count, np.ones(len(numbers), np.int64)]), len(both)).astype(np.int64)
        lose = int(np.partition(count, -FREQUENT - 1)[-FREQUENT - 1]) if len(count) > FREQUENT else 0
        keep = count > lose
        self.number, self.count, self.total = both[keep], count[keep] - lose, self.total + len(numbers)


def _sent(w: textkit.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and document of windows; of neighbours that share an anchor the first."""
    at, value, _ = anchors(w, length, gram)
    d = w.doc[at]
    keep = np.ones(len(at), bool)
    keep[1:] = (value[1:] != value[:-1]) | (d[1:] != d[:-1])
    return value[keep].view(np.int64), d[keep]


def _measure(length: int, gram: int):
    """doc_id, n and seq of each text with a window; then null, count and anchor of a task's common anchors, and their total."""
    names = ["doc_id", "n", "seq"]

    def of(batches):
        common, known = Summary(), textkit.Remembered()
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"), False)
                seq = textkit.sequence_ids(w)
                anchor, d = _sent(w, length, gram)
                common.add(anchor[known.fresh(seq)[d]])
                long = pa.array(w.count >= length)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(long), pa.array(w.count.astype(np.int64)).filter(long), pa.array(seq).filter(long)], names=names)
        count, number = pa.array([*common.count.tolist(), common.total], pa.int64()), pa.array([*common.number.tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(count), pa.int64()), count, number], names=names)

    return of


def _send(length: int, gram: int):
    def of(batches):
        known = textkit.Remembered()  # texts of this task; a copy need not be sent twice
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"), False)
                seq = textkit.sequence_ids(w)
                anchor, d = _sent(w, length, gram)
                keep = known.fresh(seq)[d]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(seq[d[keep]])], names=["anchor", "seq"])

    return of


def _repeated(hot: int, wide: np.ndarray):
    """Rows (anchor, seq) sorted: those of anchors that two or more texts have, marked when more than ``hot`` have it.

    Anchors of ``wide`` are known to be hot; their rows are dealt over several tasks.
    """

    def out(rows: list[np.ndarray], anchor: int, is_hot: bool):
        seq = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(np.full(len(seq), anchor)), pa.array(np.full(len(seq), is_hot))], names=["seq", "anchor", "hot"])

    def of(batches):
        anchor, last, rows, n, flowing = None, None, [], 0, False
        for b in batches:
            a, s = b.column("anchor").to_numpy(), b.column("seq").to_numpy()
            if len(wide) and (some := np.isin(a, wide)).any():
                yield pa.RecordBatch.from_arrays([pa.array(s[some]), pa.array(a[some]), pa.array(np.ones(int(some.sum()), bool))], names=["seq", "anchor", "hot"])
                a, s = a[~some], s[~some]
            if not len(a):
                continue
            same = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
            keep = np.append(not (anchor == a[0] and last == s[0]), ~same)
            last = s[-1]
            a, s = a[keep], s[keep]
            cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(a)))
            # runs that lie inside the batch go at once; the first and the last may go on
            if len(cut) > 2:
                mid = np.arange(1, len(cut) - 1)
                mid = mid[size[mid] >= 2]
                if len(mid):
                    take = np.repeat(cut[mid], size[mid]) + np.arange(size[mid].sum()) - np.repeat(np.cumsum(size[mid]) - size[mid], size[mid])
                    yield pa.RecordBatch.from_arrays([pa.array(s[take]), pa.array(a[take]), pa.array(np.repeat(size[mid] > hot, size[mid]))], names=["seq", "anchor", "hot"])
            for k in {0, len(cut) - 1} if len(cut) else ():
                lo, hi = cut[k], cut[k] + size[k]
                if a[lo] != anchor:
                    if n >= 2 and not flowing:
                        yield out(rows, anchor, n > hot)
                    anchor, rows, n, flowing = int(a[lo]), [], 0, False
                rows.append(s[lo:hi])
                n += int(hi - lo)
                if n > hot:
                    yield out(rows, anchor, True)
                    rows, flowing = [], True
        if n >= 2 and not flowing:
            yield out(rows, anchor, n > hot)

    return of


def _segments(length: int, gram: int):
    """Segments of each fetched text: shard, own hash, words, the text's id, first word and number of words.

    A segment that this task has sent before comes without its words.
    """

    def of(batches):
        sent = textkit.Remembered()
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"), False)
                right = textkit.sequence_ids(w) == part.column("seq").to_numpy()
                at, value, place = anchors(w, length, gram)
                d = w.doc[at]
                cold, hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
                edge = np.searchsorted(d, np.arange(len(right) + 1))
                for name, mark in (("cold", cold), ("hot", hot)):
                    for i, known in enumerate(part.column(name).to_pylist()):
                        if known and right[i]:
                            mark[edge[i] : edge[i + 1]] = np.isin(value[edge[i] : edge[i + 1]], np.array(known, np.int64).view(U64))
                new = np.append(True, (place[1:] != place[:-1]) | (d[1:] != d[:-1])) if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(cold & new)
                ends = np.append(np.flatnonzero(new), len(at))
                count = ends[np.searchsorted(ends, first, "right")] - first if len(first) else np.zeros(0, np.int64)
                one = np.flatnonzero(hot)
                lo = np.concatenate([at[first], at[one]])
                size = np.concatenate([count + length - 1, np.full(len(one), length)]).astype(np.int64)
                if not len(lo):
                    continue
                own = np.zeros(len(lo), U64)
                for k in np.unique(size).tolist():
                    some = np.flatnonzero(size == k)
                    own[some] = textkit.grams(w.hash, k)[lo[some]]
                shard = np.concatenate([value[first], own[len(first) :]])
                fresh = sent.fresh(own.view(np.int64))
                raw = memoryview(w.raw)
                data = pa.array([bytes(raw[a:b]) if f else None for a, b, f in zip(w.starts[lo].tolist(), w.ends[lo + size - 1].tolist(), fresh.tolist(), strict=True)], pa.binary())
                doc = np.concatenate([d[first], d[one]])
                ids = part.column("doc_id").to_numpy()[doc]
                cols = [pa.array(shard.view(np.int64)), pa.array(own.view(np.int64)), data, pa.array(ids), pa.array((lo - w.at[doc]).astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "segment", "data", "doc_id", "start", "size"])

    return of


def search_shard(texts: pa.Array, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (first word, end) of the repeated windows of each text, and the texts' offsets among the intervals."""
    w = textkit.words(texts, False)
    symbols = np.unique(w.hash, return_inverse=True)[1]
    index = FMIndex(symbols, w.count, length)
    order = np.unique(ids, return_inverse=True)[1]
    within = np.arange(len(w)) - w.at[w.doc]
    ends = np.flatnonzero(within >= length - 1)
    hit = ends[index.matching_statistics(symbols, ends, order, order[w.doc[ends]]) >= length]
    mark = np.zeros(len(w), bool)
    mark[hit] = True
    first, last = textkit.runs(mark, w.doc)
    return np.stack([within[first] - (length - 1), within[last] + 1], 1), np.searchsorted(w.doc[first], np.arange(len(w.count) + 1))


def _search(length: int):
    """Rows (shard, segment, data, doc_id, n, many) sorted by shard: segment, owner, n, spans of those that are repeated."""

    def out(held):
        t = pa.Table.from_batches(held)
        spans, at = search_shard(t["data"].combine_chunks(), t["doc_id"].to_numpy(), length)
        lists = pa.ListArray.from_arrays(pa.array((2 * at).astype(np.int32)), pa.array(spans.ravel().astype(np.int32)))
        some = pa.array(t["many"].to_numpy(zero_copy_only=False).astype(bool) | (at[1:] > at[:-1]))
        cols = [t["segment"].combine_chunks(), t["doc_id"].combine_chunks(), t["n"].combine_chunks(), lists]
        yield pa.RecordBatch.from_arrays(cols, names=["segment", "owner", "n", "spans"]).filter(some)

    def of(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard").to_numpy()
            off = np.frombuffer(b.column("data").buffers()[1], np.int32)[b.column("data").offset :][: b.num_rows + 1]
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            if held and held[-1].column("shard")[-1].as_py() == shard[0]:
                edges = edges[1:]
            lo = 0
            # a shard ends where it is full and another anchor begins
            for e in edges.tolist():
                if size + int(off[e] - off[lo]) >= SHARD:
                    if e > lo:
                        held.append(b.slice(lo, e - lo))
                    if held:
                        yield from out(held)
                    held, size, lo = [], 0, e
            held.append(b.slice(lo))
            size += int(off[b.num_rows] - off[lo])
        if held:
            yield from out(held)

    return of


def removed_windows(src: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the fates of its texts that lose words, one after another: hash, number of intervals (-1: all words), intervals."""
    if length <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    spark = src.sparkSession
    src = src.where("doc_id IS NOT NULL")
    textkit.bounded_batches(spark)
    measured = textkit.written(src.mapInArrow(textkit.releasing(_measure(length, GRAM)), "doc_id bigint, n bigint, seq bigint"), "texts")
    known = measured.where("doc_id IS NOT NULL").select("doc_id", "seq")
    owner = known.groupBy("seq").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # an anchor with 2 / FREQUENT of all rows shows with half of them at least, and at most FREQUENT can
    common = measured.where("doc_id IS NULL").groupBy("seq").agg(F.sum("n").alias("n"))
    total = common.where("seq IS NULL").agg(F.sum("n")).first()[0] or 0
    wide = [r["seq"] for r in common.where((F.col("n") > HOT) & (F.col("n") * FREQUENT >= total) & F.col("seq").isNotNull()).collect()]
    sent = src.select("text").mapInArrow(textkit.releasing(_send(length, GRAM)), "anchor bigint, seq bigint")
    if wide:
        dealt = F.broadcast(spark.createDataFrame([(x, DEAL) for x in wide], "anchor bigint, deal int"))
        sent = sent.join(dealt, "anchor", "left").select("anchor", "seq", F.coalesce(F.pmod("seq", "deal"), F.lit(0)).alias("deal"))
        sent = sent.repartition("anchor", "deal").select("anchor", "seq")
    else:
        sent = sent.repartition("anchor")
    sent = sent.sortWithinPartitions("anchor", "seq")
    repeated = textkit.written(sent.mapInArrow(textkit.releasing(_repeated(HOT, np.array(wide, np.int64))), "seq bigint, anchor bigint, hot boolean"), "anchors")
    del sent
    textkit.free(spark)
    pick = lambda hot: F.collect_set(F.when(F.col("hot") == hot, F.col("anchor")))
    wanted = repeated.groupBy("seq").agg(pick(False).alias("cold"), pick(True).alias("hot")).join(owner, "seq").select(F.col("first").alias("id"), "seq", "cold", "hot")
    fetched = src.join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text", "seq", "cold", "hot")
    segments = textkit.written(fetched.mapInArrow(textkit.releasing(_segments(length, GRAM)), "shard bigint, segment bigint, data binary, doc_id bigint, start int, size int"), "segments")
    textkit.drop_written(repeated)
    textkit.free(spark)
    each = segments.groupBy("shard", "segment").agg(F.min("doc_id").alias("doc_id"), F.first("data", True).alias("data"), F.count("*").alias("n"), (F.max("doc_id") > F.min("doc_id")).alias("many"))
    dealt = each.select("shard", "segment", "data", "doc_id", "n", "many").repartition("shard").sortWithinPartitions("shard")
    with textkit.batches_of(spark, 20_000):
        found = textkit.written(dealt.mapInArrow(textkit.releasing(_search(length)), "segment bigint, owner bigint, n bigint, spans array<int>"), "found")
    textkit.free(spark)
    answers = textkit.joined_by(segments.select("segment", "doc_id", "start", "size"), found, "segment")
    # the owner loses the intervals that smaller segments hold, any other text the whole segment
    moved = F.transform("spans", lambda x: x + F.col("start"))
    spans = F.when(F.col("doc_id") == F.col("owner"), moved).otherwise(F.array("start", F.col("start") + F.col("size")))
    hits = answers.select("doc_id", spans.alias("spans")).where(F.size("spans") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a fate is flat: the text's hash, the number of intervals (-1: all words go), the intervals
    own = hits.join(owner.select("seq", F.col("first").alias("doc_id")), "doc_id")
    own = own.select("doc_id", F.concat(F.array("seq", (F.size("spans") / 2).cast("bigint")), F.col("spans").cast("array<bigint>")).alias("fate"))
    copies = textkit.joined_by(known, owner, "seq").where("first < doc_id").select("doc_id", "seq").distinct()
    copies = copies.select("doc_id", F.array("seq", F.lit(-1).cast("bigint")).alias("fate"))
    out = textkit.written(own.unionByName(copies).groupBy("doc_id").agg(F.flatten(F.collect_list("fate")).alias("fates")), "fates")
    for f in (segments, found, measured):
        textkit.drop_written(f)
    textkit.free(spark)
    return out


def _gone(w: textkit.Words, fates: pa.Array) -> np.ndarray:
    """Which words of the batch go."""
    out = np.zeros(len(w), bool)
    seq = textkit.sequence_ids(w)
    for i in np.flatnonzero(fates.is_valid().to_numpy(zero_copy_only=False)).tolist():
        own, at = fates[i].values.to_numpy(), 0
        lo, n = int(w.at[i]), int(w.count[i])
        while at < len(own):
            k = int(own[at + 1])
            if own[at] == seq[i]:
                if k < 0:
                    out[lo : lo + n] = True
                else:
                    s = own[at + 2 : at + 2 + 2 * k]
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, s[::2], 1)
                    np.add.at(step, s[1::2], -1)
                    out[lo : lo + n] |= np.cumsum(step)[:n] > 0
            at += 2 + 2 * max(0, k)
    return out


def _kept_texts(w: textkit.Words, gone: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    at = np.flatnonzero(~gone)
    size = w.ends[at] - w.starts[at] + 1
    off = np.cumsum(size) - size
    spot = np.repeat(w.starts[at] - off, size) + np.arange(int(size.sum()))
    buf = np.append(w.raw, np.uint8(32))[np.minimum(spot, len(w.raw))]
    buf[off + size - 1] = 32
    edge = np.append(off, len(buf))[np.searchsorted(at, w.at)]
    data = buf.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _with_fates(docs: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of fates more, and its name, which no other column has."""
    fates = removed_windows(_source(docs, doc_id, text), length)
    key, name = (textkit.free_name(docs, n) for n in ("fate_of", "fates"))
    fates = fates.select(F.col("doc_id").alias(key), F.col("fates").alias(name))
    return docs.join(fates, docs[doc_id].cast("bigint") == fates[key], "left").drop(fates[key]), name


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, the digest of the kept words and the removed intervals (word numbers), of every row."""

    def of(batches):
        for batch in batches:
            for part in textkit.slices(batch):
                w = textkit.words(part.column("text"), False)
                gone = _gone(w, part.column(fates))
                kept = [hashlib.sha256(x).hexdigest() for x in _kept_texts(w, gone)]
                removed = np.bincount(w.doc[gone], minlength=len(w.count))
                first, last = textkit.runs(gone, w.doc)
                spans = pa.StructArray.from_arrays([pa.array(first - w.at[w.doc[first]]), pa.array(last + 1 - w.at[w.doc[first]])], ["start", "end"])
                at = np.searchsorted(w.doc[first], np.arange(len(w.count) + 1)).astype(np.int32)
                cols = [part.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(at), spans)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    src, fates = _with_fates(_source(docs, doc_id, text), "doc_id", "text", length)
    return src.select("doc_id", "text", fates).mapInArrow(textkit.releasing(of), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the kept words as its text; rows that lose every word go.

    A text that loses nothing stays as it is, white space, null and empty included; others
    hold their kept words joined by one space.  Rows with a null id stay as they are.
    """
    names, schema = docs.columns, docs.schema
    where = names.index(text)

    def of(batches):
        for batch in batches:
            for part in textkit.slices(batch, text):
                w = textkit.words(part.column(text), False)
                gone = _gone(w, part.column(fates))
                removed = np.bincount(w.doc[gone], minlength=len(w.count))
                kept = [o if not r else k.decode("utf-8", "replace") for o, k, r in zip(part.column(text).to_pylist(), _kept_texts(w, gone), removed.tolist(), strict=True)]
                cols = [part.column(c) for c in names]
                cols[where] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array((removed == 0) | (removed < w.count)))

    rows, fates = _with_fates(docs, doc_id, text, length)
    return rows.select(*names, fates).mapInArrow(textkit.releasing(of), schema)


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL for the digests of ``documents``: every window, and the smallest document that holds it."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {length}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - {length - 1})) AS i FROM d WHERE len(w) >= {length})),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + {length})) AS p FROM win JOIN least USING (s) WHERE m < win.doc_id)),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
