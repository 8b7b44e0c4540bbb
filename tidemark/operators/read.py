"""Reading: tier by age, snapped windows, buffered points, merged replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import glob
from tidemark.operators import catalog as cat
from tidemark.plans.frame import Series, shaped


class RangeError(ValueError):
    """The start lies after the end."""


def tier_of(start: int, now: int) -> Column:
    """The finest tier that covers the age of ``start`` (cut to the longest tier)."""
    length = lambda a: a["precision"].cast("bigint") * a["points"]
    longest = F.array_max(F.transform("archives", length))
    age = F.lit(now) - F.greatest(F.lit(start), F.lit(now) - longest)
    return F.array_position(F.transform("archives", lambda a: length(a) >= age), F.lit(True)).cast("int") - 1


def window(catalog: DataFrame, start: int, end: int, now: int) -> DataFrame:
    """key, tier, step and the snapped half-open window of every series; step 0 where nothing can be read."""
    if start > end:
        raise RangeError("start is after end")
    end = min(end, now)
    c = catalog.withColumn("tier", tier_of(start, now)).withColumn("step", F.get("archives", F.col("tier"))["precision"].cast("bigint"))
    longest = F.array_max(F.transform("archives", lambda a: a["precision"].cast("bigint") * a["points"]))
    lo = F.greatest(F.lit(start).cast("bigint"), F.lit(now) - longest)
    snap = lambda x: x - F.pmod(x, F.col("step")) + F.col("step")
    none = F.lit(start > now or start == 0 or end == 0) | (F.lit(end) < F.lit(now) - longest)
    return c.select(
        "key", "tier",
        F.when(none, 0).otherwise(F.col("step")).cast("bigint").alias("step"),
        F.when(none, F.lit(start)).otherwise(snap(lo)).cast("bigint").alias("start_time"),
        F.when(none, F.lit(end)).otherwise(snap(F.lit(end).cast("bigint"))).cast("bigint").alias("end_time"),
    )


def read(catalog: DataFrame, points: DataFrame, patterns: list[str], start: int, end: int, now: int, **how) -> tuple[DataFrame, DataFrame]:
    """Headers (query, name, step, start_time, end_time) and data (query, name, ts, value).

    A literal without a series has step 0 and the requested times.  Tiers are never
    stitched: one read takes one tier of a series.
    """
    found = cat.resolve(catalog, patterns, **how)
    w = window(catalog, start, end, now)
    head = found.join(w, "key", "left").select(
        F.col("pattern").alias("query"), F.col("key").alias("name"), "tier", F.coalesce("step", F.lit(0)).cast("bigint").alias("step"),
        F.coalesce("start_time", F.lit(start)).cast("bigint").alias("start_time"), F.coalesce("end_time", F.lit(end)).cast("bigint").alias("end_time"),
    )
    # the literal bounds reach the scan, and no slot of a window lies outside of them; the exact window is per series
    p = points.where((F.col("ts") >= start) & (F.col("ts") <= end)).select("key", "tier", "ts", "value")
    live = head.where("step > 0 AND start_time < end_time").withColumnRenamed("name", "key")
    data = live.join(p, ["key", "tier"]).where("ts >= start_time AND ts < end_time").select("query", F.col("key").alias("name"), "ts", "value")
    return head.drop("tier"), data


def read_all(catalog: DataFrame, points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The metadata and every point of all tiers of one literal key."""
    return catalog.where(F.col("key") == key), points.where((F.col("key") == key) & F.col("value").isNotNull()).select("tier", "ts", "value")


def series(catalog: DataFrame, points: DataFrame, pattern: str, start: int, end: int, now: int, keep=None, **how) -> Series:
    """A pattern's series as a set for the query language; NaN becomes null.

    ``keep``, a function of the catalogue, leaves some of its rows; only their points are read.
    """
    c = catalog.where(glob.condition(F.col("key"), pattern, **how))
    c = keep(c) if keep is not None else c
    w = window(c, start, end, now).where("step > 0")
    sid = F.xxhash64("key")
    tags = F.col("tags") if "tags" in catalog.columns else F.expr("cast(map() as map<string,string>)")
    dim = w.join(c.select("key", tags.alias("tags")), "key").select(sid.alias("sid"), F.col("key").alias("name"), "start_time", "end_time", "step", "tags")
    p = points.where(glob.condition(F.col("key"), pattern, **how) & (F.col("ts") >= start) & (F.col("ts") <= end))
    hit = p.join(w.select("key", "tier", "start_time", "end_time"), ["key", "tier"]).where("ts >= start_time AND ts < end_time")
    return Series(shaped(dim), hit.select(sid.alias("sid"), "ts", F.nanvl("value", F.lit(None).cast("double")).alias("value")))


def overlay_pending(head: DataFrame, data: DataFrame, pending: DataFrame, start: int, end: int) -> DataFrame:
    """Read data with points that still wait in a buffer (key, ts, value, arrival) laid over it.

    Pending points with start <= ts <= end take their slot; the newest second of a slot wins.
    """
    p = pending.where((F.col("ts") >= start) & (F.col("ts") <= end)).join(head.where("step > 0").select("query", F.col("name").alias("key"), "step"), "key")
    slot = F.col("ts") - F.pmod("ts", "step")
    w = Window.partitionBy("query", "key", "slot").orderBy(F.desc("ts"), F.desc("arrival"))
    top = p.withColumn("slot", slot).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("query", F.col("key").alias("name"), F.col("slot").alias("ts"), "value")
    return top.unionByName(data.join(top.select("query", "name", "ts"), ["query", "name", "ts"], "left_anti"))


def merge_reads(heads: list[DataFrame], data: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Reads of several stores as one: equal steps are concatenated, empty ones replaced, different steps an error."""
    h = heads[0].withColumn("_s", F.lit(0))
    d = data[0]
    for k, (x, y) in enumerate(zip(heads[1:], data[1:], strict=True), 1):
        h, d = h.unionByName(x.withColumn("_s", F.lit(k))), d.unionByName(y)
    live = F.when(F.col("step") > 0, F.col("step"))
    steps = F.collect_set(live)
    g = h.groupBy("query", "name").agg(F.coalesce(F.max(live), F.lit(0)).cast("bigint").alias("step"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.when(F.size(steps) > 1, "merged results with different schemas").otherwise("").alias("error"))
    bad = g.where("error <> ''").select("query", "name")
    return g, d.join(bad, ["query", "name"], "left_anti")
