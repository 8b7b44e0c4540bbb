"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line; with ``wrapped`` also each window of 2 n words that starts at a
multiple of n, n being the number of words of the template, so that a notice is found
however its lines are broken or commented.  Block b matches template t when |t & b| >= threshold * |t| over
distinct words.  Words are ordered by their frequency in all blocks, rarest first, so

* prefix: a match shares one of the first |t| - o + 1 words of t (o: overlap needed),
  and that word is among the first |b| - o + 1 of b;
* length: |b| >= o;
* positional: where i and j are the places of the first shared word,
  1 + min(|t| - i - 1, |b| - j - 1) >= o

leave few pairs, whose overlap is then counted.  Only words of some template matter,
so b is cut to those first.  Everything is DataFrame operations: blocks that hold a
prefix word meet the templates' prefixes in a broadcast join on the word's rank (the
templates are a constant), and the matches of a text return to its rows by the text's
hash.  The one gathered table has a row for each template word.

Beside these blocks, phrases are found wherever their words stand consecutively.

Defined results: a null or empty text has no word, place or label; repeated rows and
null ids each give a row; a template without a word is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: letters, digits and all beyond ASCII, after A-Z are lower-cased; and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: License notices and their labels (fixed values).
TEMPLATES = (
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by 4.0", "cc-by-4.0"),
    ("licensed under cc by nc 4.0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4.0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution license", "cc-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-grant"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("dedicated to the public domain under cc0 1.0 universal", "cc0"),
)
THRESHOLD = (4, 5)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; ``text`` is lower-cased already."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Plan:
    """Templates as rank lists under the global word order."""

    rank: dict[str, int]
    templates: list[tuple[str, list[int], int, int]]  # label, ranks ascending, overlap needed, prefix length
    prefix_words: list[str]


def plan(docs: DataFrame, text: str, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> Plan:
    """Count the templates' words over all blocks and order them; ``text`` is lower-cased already."""
    sets = [(label, sorted(set(_tokens(t)))) for t, label in templates]
    if any(not s for _, s in sets):
        raise ValueError("a template has no word")
    universe = sorted({w for _, s in sets for w in s})
    counts = docs.select(F.explode(words(F.col(text))).alias("w")).where(F.col("w").isin(universe)).groupBy("w").count()
    n = {r["w"]: r["count"] for r in counts.collect()}  # a row for each template word at most
    order = sorted(universe, key=lambda w: (n.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    up, down = threshold
    out = []
    for label, s in sets:
        need = -(-up * len(s) // down)
        out.append((label, sorted(rank[w] for w in s), need, len(s) - need + 1))
    return Plan(rank, out, sorted({order[r] for _, ranks, _, p in out for r in ranks[:p]}))


HITS = "array<struct<block:int,label:string,overlap:int,size:int>>"


def matches(p: Plan, texts: DataFrame) -> DataFrame:
    """key and hits (HITS) of each text with a match.  ``texts``: key, lower-cased text."""
    spark = texts.sparkSession
    prefix = F.array(*map(F.lit, p.prefix_words))
    known = F.array(*(F.lit(w) for w in p.rank))
    rank = F.create_map(*(F.lit(x) for w, r in p.rank.items() for x in (w, r)))
    worth = texts.where(F.arrays_overlap(words(F.col("text")), prefix))
    lines = worth.select("key", F.posexplode(F.split("text", "\n")).alias("block", "line")).select("key", "block", words(F.col("line")).alias("w"))
    blocks = lines.where(F.arrays_overlap("w", prefix)).select("key", "block", F.array_sort(F.transform(F.array_intersect("w", known), lambda w: F.element_at(rank, w))).alias("b"))
    rows = [(ranks[i], label, ranks, i, need) for label, ranks, need, n in p.templates for i in range(n)]
    heads = spark.createDataFrame(rows, "r int, label string, ranks array<int>, i int, need int")
    j, size, of = F.col("j"), F.size("b"), F.size("ranks")
    met = blocks.select("key", "block", "b", F.posexplode("b").alias("j", "r")).join(F.broadcast(heads), "r")
    met = met.where((size >= F.col("need")) & (j <= size - F.col("need")) & (F.least(of - F.col("i"), size - j) >= F.col("need")))
    overlap = F.size(F.array_intersect("ranks", "b"))
    hit = met.select("key", F.struct(F.col("block").cast("int").alias("block"), "label", overlap.alias("overlap"), of.alias("size")).alias("hit"), "need").where(F.col("hit.overlap") >= F.col("need"))
    return hit.groupBy("key").agg(F.array_sort(F.collect_set("hit")).cast(HITS).alias("hits"))


def windows(p: Plan, texts: DataFrame, templates) -> DataFrame:
    """key and hits of each text with a window of 2 n words that matches a template of n words; ``block`` is the window's number.

    A match holds a prefix word of its template, so only the windows around those are read.
    """
    spark = texts.sparkSession
    length = {label: len(_tokens(t)) for t, label in templates}
    reach = 2 * max(length.values())
    word = {r: w for w, r in p.rank.items()}
    rows = [(word[r], label, [word[x] for x in ranks], length[label], need) for label, ranks, need, n in p.templates for r in ranks[:n]]
    heads = spark.createDataFrame(rows, "x string, label string, words array<string>, n int, need int")
    prefix = F.array(*map(F.lit, p.prefix_words))
    w = texts.select("key", words(F.col("text")).alias("w")).where(F.arrays_overlap("w", prefix))
    # each prefix word with the words around it, not with its whole text
    around = F.transform("w", lambda x, i: F.when(F.array_contains(prefix, x), F.struct(x.alias("x"), i.alias("at"))))
    near = w.select("key", "w", F.filter(around, lambda x: x.isNotNull()).alias("a"))
    low = lambda x: F.greatest(x["at"] - (reach - 1), F.lit(0))
    near = near.select("key", F.explode(F.transform("a", lambda x: F.struct(x["x"].alias("x"), x["at"].alias("at"), low(x).alias("low"), F.slice(F.col("w"), low(x) + 1, 2 * reach).alias("ctx")))).alias("c")).select("key", "c.*")
    met = near.join(F.broadcast(heads), "x")
    last = F.floor(F.col("at") / F.col("n")).cast("int")
    met = met.select("*", F.explode(F.filter(F.array(last - 1, last), lambda k: k >= 0)).alias("k"))
    own = F.slice("ctx", (F.col("k") * F.col("n") - F.col("low") + 1).cast("int"), (F.col("n") * 2).cast("int"))
    hit = met.select("key", "need", F.struct(F.col("k").alias("block"), "label", F.size(F.array_intersect("words", own)).alias("overlap"), F.size("words").alias("size")).alias("hit"))
    return hit.where(F.col("hit.overlap") >= F.col("need")).groupBy("key").agg(F.array_sort(F.collect_set("hit")).cast(HITS).alias("hits"))


def places(phrase: str, w: Column) -> Column:
    """Starts, from 0, of the places where the phrase's words stand consecutively."""
    parts = _tokens(phrase)

    def here(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for j, x in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + j) == x)
        return out

    none = F.expr("cast(array() as array<int>)")
    return F.when(F.array_contains(w, parts[0]) & (F.size(w) >= len(parts)), F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), here)).otherwise(none)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """doc_id, n_words, places (array<struct<label, start>>) and hits (HITS: block, label, shared and all words of the template) of every row."""
    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), lowered(docs[text]).alias("text")).withColumn("key", F.xxhash64("text"))
    p = plan(src, "text", templates, threshold)
    found = matches(p, src.select("key", "text"))
    if wrapped:
        more = windows(p, src.select("key", "text"), templates)
        found = found.unionByName(more).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    main = src.select("doc_id", "key", words(F.col("text")).alias("w"))
    w = F.col("w")

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(phrase, w), lambda i: F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("start")))

    main = main.select("doc_id", "key", F.size("w").cast("bigint").alias("n_words"), F.concat(*(labelled(*x) for x in phrases)).alias("places"))
    return main.join(found, "key", "left").select("doc_id", "n_words", "places", F.coalesce("hits", F.expr(f"cast(array() as {HITS})")).alias("hits"))


def license_labels(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: word count, phrase places, base labels, all labels and the best containment."""
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"])))
    base, own = names(F.col("places")), names(F.col("hits"))
    share = F.array_max(F.transform("hits", lambda x: x["overlap"] / x["size"]))
    starts = F.transform("places", lambda x: x["start"])
    return scan(docs, **how).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def wrapped_oracle() -> str:
    """DuckDB SQL for ``license_labels(documents, wrapped=True)``: every line and every window against every template."""
    n = ", ".join(f"('{label}', {len(_tokens(t))})" for t, label in TEMPLATES)
    up, down = THRESHOLD
    lines = "hits AS ("
    windows = f"""lengths(label, n) AS (VALUES {n}),
spots AS (SELECT doc_id, label, t, list_distinct(w[k * n + 1 : k * n + 2 * n]) AS b FROM (SELECT doc_id, w, label, t, n, unnest(range((len(w) + n - 1) // n)) AS k FROM d, templates JOIN lengths USING (label))),
shares AS (SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS share FROM spots WHERE {down} * len(list_intersect(t, b)) >= {up} * len(t)
UNION ALL SELECT doc_id, label, len(list_intersect(t, b)) / len(t) FROM blocks, templates WHERE {down} * len(list_intersect(t, b)) >= {up} * len(t)),
hits AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS labels, max(share) AS share FROM shares GROUP BY doc_id)
"""
    sql = oracle()
    at = sql.index(lines)
    return sql[:at] + windows + sql[sql.index("SELECT d.doc_id, len(w)", at) :]


def oracle() -> str:
    """DuckDB SQL for ``license_labels(documents)``: every line against every template."""
    fold = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    seq = " UNION ALL ".join(f"SELECT {_tokens(p)!r} AS p, '{label}' AS label" for p, label in PHRASES)
    sets = " UNION ALL ".join(f"SELECT {sorted(set(_tokens(t)))!r} AS t, '{label}' AS label" for t, label in TEMPLATES)
    up, down = THRESHOLD
    return f"""
WITH d AS (SELECT doc_id, {fold} AS text, regexp_extract_all({fold}, {word}) AS w FROM documents),
phrases AS ({seq}), templates AS ({sets}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE text LIKE '%license%' OR text LIKE '%cc%') x, phrases WHERE w[i + 1 : i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, {word})) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
hits AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS labels, max(len(list_intersect(t, b)) / len(t)) AS share FROM blocks, templates WHERE {down} * len(list_intersect(t, b)) >= {up} * len(t) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hits.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)
"""
