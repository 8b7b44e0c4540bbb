"""Benchmark decontamination: MinHash containment search, size by size, then an exact check.

An item is contaminating a document when at least ``THRESHOLD`` of its distinct word
shingles stand in the document.  A short item inside a long document has a tiny
Jaccard similarity, so containment is searched instead: an item's sketch is its
``k`` smallest shingle hashes (bottom-k MinHash), and a document is a candidate when
one of its own shingles is in the sketch.

Items are partitioned by size, in powers of two.  A match may miss at most
``floor((1 - THRESHOLD) * n)`` of n shingles, so with

    k(partition) = floor((1 - THRESHOLD) * largest size of the partition) + 1

every match shares a sketch hash: the search loses nothing.  Candidates are then
verified by counting shared shingles as text, not as hashes.

The sketches are broadcast only if they were counted and have at most
``BROADCAST_ROWS`` rows; beyond, the same join shuffles.  All steps are DataFrame
expressions.

Defined results: words are those of the license scan (A-Z lower-cased, punctuation
ignored); an item of fewer than ``SHINGLE`` words is one shingle, its whole word
sequence, and is contained where those words stand consecutively; an item without a
word matches nothing; a null text has no shingle; equal rows (id and text) give one
result; rows with equal ids and different texts are searched one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin

SHINGLE = 5
THRESHOLD = (4, 5)
BROADCAST_ROWS = 1 << 20


def _grams(w: Column, n: int, each) -> Column:
    """``each`` of every n consecutive words; empty if there are fewer."""
    none = F.filter(F.transform(F.slice(w, 1, 1), lambda _: each([F.lit("")] * n)), lambda _: F.lit(False))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: each([F.get(w, i + j) for j in range(n)]))).otherwise(none)


def hashes(w: Column, n: int) -> Column:
    return _grams(w, n, lambda x: F.xxhash64(*x))


def shingles(w: Column, n: int) -> Column:
    return _grams(w, n, lambda x: F.concat_ws(" ", *x))


def _items(items: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    """item_id, length of its shingles, and its distinct shingles as text."""
    w = setjoin.words(setjoin.lowered(items[text]))
    src = items.select(items[item_id].cast("bigint").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(shingle))
    whole = F.array(F.concat_ws(" ", "w"))
    return src.select("item_id", length.alias("length"), F.array_distinct(F.when(F.size("w") >= shingle, shingles(F.col("w"), shingle)).otherwise(whole)).alias("own")).dropDuplicates(["item_id", "own"])


def pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """As ``search``, with key: the hash of the document's lower-cased text."""
    up, down = threshold
    its = _items(items, item_id, item_text, shingle)
    # the hash of a shingle is taken from its words, so that documents need not build texts
    n = F.size("own")
    largest = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")  # of the item's partition
    k = F.floor((down - up) * largest / down).cast("int") + 1
    parts = F.transform("own", lambda s: F.split(s, " "))
    lengths = sorted(r[0] for r in its.select("length").distinct().collect())  # at most ``shingle`` values

    def hashed_words(x: int) -> Column:
        return F.transform(parts, lambda p: F.xxhash64(*(F.get(p, F.lit(j)) for j in range(x))))

    hashed = F.lit(None).cast("array<bigint>")
    for x in lengths:
        hashed = F.when(F.col("length") == x, hashed_words(x)).otherwise(hashed)
    sketch = its.select("item_id", "length", n.alias("n"), F.explode(F.slice(F.array_sort(hashed), F.lit(1), F.least(k, n))).alias("h"))
    rows = sketch.count()
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), setjoin.lowered(docs[text]).alias("text"))
    keyed = src.select("doc_id", F.xxhash64("text").alias("key"), setjoin.words(F.col("text")).alias("w"))
    found = None
    for x in lengths:
        # length filter: the document has at least the shingles that the item needs
        part = keyed.select("doc_id", "key", F.size("w").alias("size"), F.explode(hashes(F.col("w"), x)).alias("h"))
        own = sketch.where(F.col("length") == x)
        hit = part.join(F.broadcast(own) if rows <= BROADCAST_ROWS else own, "h").where((F.col("size") - x + 1) * down >= F.col("n") * up).select("doc_id", "key", "item_id", F.lit(x).alias("length"))
        found = hit if found is None else found.unionByName(hit)
    out = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double, key bigint"
    if found is None:
        return docs.sparkSession.createDataFrame([], out)
    candidates = found.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("length", "item_id")).alias("pairs"))
    texts = src.withColumn("key", F.xxhash64("text")).withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")
    both = texts.join(candidates, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).select("doc_id", "pairs", setjoin.words(F.col("text")).alias("w"), "key")
    sets = F.create_map(*(c for x in lengths for c in (F.lit(x), F.array_distinct(shingles(F.col("w"), x)))))
    each = both.select("doc_id", "key", sets.alias("sets"), F.explode("pairs").alias("p"))
    own = its.select("item_id", "own")
    checked = each.select("doc_id", "key", F.col("p")["item_id"].alias("item_id"), F.element_at("sets", F.col("p")["length"]).alias("have"))
    checked = checked.withColumnRenamed("item_id", "i").join(F.broadcast(own) if rows <= BROADCAST_ROWS else own, F.col("i").eqNullSafe(F.col("item_id")))
    shared = F.size(F.array_intersect("own", "have"))
    kept = checked.select("doc_id", "key", "item_id", F.size("own").cast("bigint").alias("n_shingles"), shared.cast("bigint").alias("n_shared")).where(F.col("n_shared") * down >= F.col("n_shingles") * up)
    return kept.distinct().select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "key")


def search(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared and containment of every pair that reaches the threshold.

    ``how``: doc_id, text, item_id, item_text (column names), shingle, threshold.
    """
    return pairs(docs, items, **how).drop("key")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = pairs(docs, items, doc_id=doc_id, text=text, **how).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = docs[doc_id].cast("bigint").eqNullSafe(found["_id"]) & (F.xxhash64(setjoin.lowered(docs[text])) == found["_key"])
    return docs.join(found, same, "left_anti")


def oracle() -> str:
    """DuckDB SQL for ``search(documents, benchmark)``: all shared shingles, counted."""
    fold = f"translate(coalesce(text, ''), '{setjoin.UPPER}', '{setjoin.LOWER}')"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    up, down = THRESHOLD
    n = SHINGLE
    return f"""
WITH i AS (SELECT item_id, regexp_extract_all({fold}, {word}) AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all({fold}, {word}) AS w FROM documents),
own AS (SELECT DISTINCT item_id, least(len(w), {n}) AS size, array_to_string(w[k : k + least(len(w), {n}) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM own),
have AS (SELECT DISTINCT doc_id, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
total AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, (count(*) / any_value(n))::DOUBLE AS containment
FROM own JOIN have USING (size, s) JOIN total USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * {down} >= any_value(n) * {up}
"""
