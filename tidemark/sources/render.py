"""Sinks: JSON, pickle and HTML forms of reads and finds, and stats as series."""

from __future__ import annotations

import html
import json
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.frame import Series


def json_targets(s: Series) -> DataFrame:
    """name and a JSON object {target, datapoints: [[value, ts], ...]} of each series with points.

    Values have six significant digits; missing ones are left out.
    """
    short = F.format_string("%.6g", F.col("value"))
    # %g keeps trailing zeros in Java; a double's own text is shorter and equal
    number = short.cast("double")
    pair = F.concat(F.lit("["), F.regexp_replace(number.cast("string"), r"\.0$", ""), F.lit(","), F.col("ts").cast("string"), F.lit("]"))
    rows = s.joined("name", "step", "ordinal").where("value IS NOT NULL AND NOT isnan(value) AND step > 0").select("sid", "name", "ordinal", F.struct("ts", pair.alias("p")).alias("p"))
    g = rows.groupBy("sid", "name", "ordinal").agg(F.array_sort(F.collect_list("p")).alias("a"))
    points = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["p"]), ","), F.lit("]"))
    quoted = F.regexp_replace(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', "$1")
    return g.select("name", "ordinal", F.concat(F.lit('{"target":'), quoted, F.lit(',"datapoints":'), points, F.lit("}")).alias("json"))


def json_document(s: Series) -> str:
    """The whole JSON array, for results that fit a reply."""
    return "[" + ",".join(r.json for r in json_targets(s).orderBy("ordinal", "name").collect()) + "]"


def json_find(found: DataFrame) -> str:
    """{pattern: [name, ...]}."""
    out: dict[str, list[str]] = {}
    for r in found.orderBy("pattern", "name").collect():
        out.setdefault(r.pattern, []).append(r.name)
    return json.dumps(out)


def graphite_find(found: DataFrame) -> str:
    """Nodes of one pattern with leaf, context, text, expandable, id and allowChildren."""
    rows = found.orderBy("name").collect()
    if len({r.pattern for r in rows}) > 1:
        raise ValueError("only one pattern can be shown")
    out = []
    for r in rows:
        name = r.name[:-2] if r.is_directory else r.name
        inner = int(r.is_directory)
        out.append({"leaf": 1 - inner, "context": {}, "text": name.rsplit(".", 1)[-1], "expandable": inner, "id": name, "allowChildren": inner})
    return json.dumps(out)


def dense_values(s: Series) -> DataFrame:
    """name, start_time, end_time, step and values of each series on its whole grid, null in gaps."""
    g = s.dense("name").groupBy("sid", "name", "start_time", "end_time", "step").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("a"))
    return g.select("name", "start_time", "end_time", "step", F.transform("a", lambda x: x["value"]).alias("values"))


def pickle_document(s: Series, path_expression: str) -> bytes:
    """A pickled list of dicts with pathExpression, name, start, end, step, values."""
    rows = dense_values(s).orderBy("name").collect()
    return pickle.dumps([{"pathExpression": path_expression, "name": r.name, "start": r.start_time, "end": r.end_time, "step": r.step, "values": list(r["values"])} for r in rows], protocol=2)


def html_find(found: DataFrame) -> str:
    """Links to each name; a directory links to a search below it."""
    items = "".join(f'<a href="?query={html.escape(r.name)}">{html.escape(r.name)}</a><br />' for r in found.orderBy("name").collect())
    return f"<html><body>{items}</body></html>"


def stat_points(stats: DataFrame, host: str, now: int, prefix: str = "tidemark") -> DataFrame:
    """Stats (name, value) as points of series ``prefix.<host>.<name>``."""
    clean = F.regexp_replace("name", r"[^A-Za-z0-9._:@#=-]", "_")
    place = "".join(c if c.isalnum() or c in "_-" else "_" for c in host)
    return stats.select(F.concat(F.lit(f"{prefix}.{place}."), clean).alias("key"), F.lit(now).cast("bigint").alias("ts"), F.col("value").cast("double").alias("value"))
