"""Writing points: validate, autocreate, pick a tier, snap to slots, roll up.

``write`` is one pure function for batches and for micro-batches of a stream.  Within one
call the oldest raw second of a slot wins (equal seconds: the latest arrival); a later
call overwrites an earlier one.  ``conflict='latest'`` lets the newest second win.

A point goes to the finest tier that still covers its age; older than all tiers it is
dropped without an error.  Each touched interval of every coarser tier is then computed
from the tier that was written, if enough of its slots are known; when no interval of a
tier has enough, the tiers after it are left alone.  Deleting a point means writing NaN:
it counts as known, makes sums and averages NaN, and is skipped by min and max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import glob, timeparse

#: (pattern, retentions, xff, method) of automatic creation, first match wins.
Rule = tuple[str, str, float, str]
METHOD_NUMBER = {v: k for k, v in timeparse.METHODS.items()} | {"avg": 1}


def archives_column(retentions: str) -> Column:
    return F.array(*(F.struct(F.lit(p).cast("int").alias("precision"), F.lit(n).cast("int").alias("points")) for p, n in timeparse.archives(retentions)))


def match_rule(key: Column, rules: list[Rule]) -> Column:
    """Number of the first rule whose pattern matches; null if none does."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        out = F.when(glob.condition(key, r[0]), F.lit(k)).otherwise(out)
    return out


def created(keys: DataFrame, rules: list[Rule]) -> DataFrame:
    """Catalogue rows for new keys; keys without a rule are left out."""
    rows = keys.withColumn("_r", match_rule(F.col("key"), rules)).where("_r IS NOT NULL")
    archives, x, agg = (F.lit(None).cast(t) for t in ("array<struct<precision:int,points:int>>", "double", "int"))
    for k, (_, retentions, factor, method) in enumerate(rules):
        hit = F.col("_r") == k
        archives = F.when(hit, archives_column(retentions)).otherwise(archives)
        x = F.when(hit, F.lit(timeparse.xff(factor))).otherwise(x)
        agg = F.when(hit, F.lit(METHOD_NUMBER[method])).otherwise(agg)
    return rows.select("key", archives.alias("archives"), x.alias("xff"), agg.alias("agg"))


def aggregate(agg: Column, value: Column, ts: Column) -> Column:
    """The aggregation method of a roll-up, by its number."""
    number = F.nanvl(value, F.lit(None).cast("double"))
    return (
        F.when(agg == 1, F.avg(value))
        .when(agg == 2, F.sum(value))
        .when(agg == 3, F.max_by(value, ts))
        .when(agg == 4, F.min(number))
        .when(agg == 5, F.max(number))
    )


def place(points: DataFrame, now: int, conflict: str = "oldest") -> DataFrame:
    """key, tier, step, ts (slot), value of raw points joined with ``archives``; one row a slot."""
    age = F.lit(now) - F.col("ts")
    fits = F.transform("archives", lambda a: a["precision"].cast("bigint") * a["points"] >= age)
    tier = F.array_position(fits, F.lit(True)).cast("int") - 1
    p = points.withColumn("tier", tier).where("tier >= 0").withColumn("step", F.get("archives", F.col("tier"))["precision"])
    p = p.withColumn("slot", F.col("ts") - F.pmod("ts", F.col("step").cast("bigint")))
    first = F.asc("ts") if conflict == "oldest" else F.desc("ts")
    w = Window.partitionBy("key", "tier", "slot").orderBy(first, F.desc("arrival"))
    return p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("key", "tier", "step", F.col("slot").alias("ts"), "value")


def rolled(source: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of the coarser tiers whose intervals hold a ``fresh`` row of ``source``, computed from all its rows there."""
    coarse = F.transform("archives", lambda a, i: F.struct(i.cast("int").alias("j"), a["precision"].alias("step_j")))
    targets = catalog.select("key", "xff", "agg", F.explode(coarse).alias("t")).select("key", "xff", "agg", "t.j", "t.step_j")
    slot = (F.col("ts") - F.pmod("ts", F.col("step_j").cast("bigint"))).alias("slot")
    rows = source.join(targets, "key").where("j > tier").select("key", "tier", "step", "j", "step_j", "xff", "agg", slot, "ts", "value", "fresh")
    sums = rows.groupBy("key", "tier", "j", "slot", "step_j", "step", "xff", "agg").agg(F.count("*").alias("known"), F.max("fresh").alias("fresh"), aggregate(F.col("agg"), F.col("value"), F.col("ts")).alias("value"))
    sums = sums.where("fresh").withColumn("ok", F.col("known") >= F.col("xff") * (F.col("step_j") / F.col("step"))).repartition("key", "tier")
    # a tier goes on only if every tier before it stored something
    any_ok = F.max(F.col("ok").cast("int")).over(Window.partitionBy("key", "tier", "j"))
    before = F.min("any").over(Window.partitionBy("key", "tier").orderBy("j").rangeBetween(Window.unboundedPreceding, -1))
    out = sums.withColumn("any", any_ok).withColumn("go", F.coalesce(before, F.lit(1))).where("ok AND go = 1")
    # two written tiers can reach one slot: the finer source wins
    return out.groupBy("key", "j", "slot").agg(F.min_by(F.struct("step_j", "value"), "tier").alias("s")).select("key", F.col("j").alias("tier"), F.col("s.step_j").alias("step"), F.col("slot").alias("ts"), F.col("s.value").alias("value"))


def overlay(*layers: DataFrame) -> DataFrame:
    """Rows of all layers, the first that has a (key, tier, ts) wins; ``fresh`` where that is the first layer."""
    out = layers[0].withColumn("_p", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("_p", F.lit(k)))
    g = out.groupBy("key", "tier", "ts").agg(F.min_by(F.struct("step", "value"), "_p").alias("s"), (F.min("_p") == 0).alias("fresh"))
    return g.select("key", "tier", F.col("s.step").alias("step"), "ts", F.col("s.value").alias("value"), "fresh")


def write(catalog: DataFrame, points: DataFrame, batch: DataFrame, rules: list[Rule], now: int, conflict: str = "oldest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New catalogue, new points, and (key, error, ignored) of every key of the batch (key, ts, value, arrival)."""
    # a union that claims its children's partitioning fails to plan once one of them is coalesced at run time
    batch.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    keys = batch.select("key").distinct()
    valid = F.col("key").rlike(glob.KEY)
    missing = keys.where(valid).join(catalog.select("key"), "key", "left_anti")
    new_catalog = catalog.unionByName(created(missing, rules)) if rules else catalog
    known = keys.join(new_catalog.select("key", F.lit(True).alias("_k")), "key", "left")
    error = F.when(~valid, "key contains invalid characters").when(F.col("_k").isNull(), "series does not exist").otherwise("")
    results = known.select("key", error.alias("error"), (~valid).alias("ignored"))
    # dealt out anew between the steps: no task holds the sorts of all of them, and placed rows are computed once for all that read them
    placed = place(batch.join(new_catalog.select("key", "archives"), "key"), now, conflict).repartition("key", "tier", "ts")
    # written tiers of the touched keys only: a roll-up never reads other series
    old = points.join(placed.select("key").distinct(), "key", "left_semi")
    up = rolled(overlay(placed, old), new_catalog)
    new = overlay(placed, up).drop("fresh")
    # the stored points are not regrouped: what the batch replaces leaves them by an anti-join on a small side
    return new_catalog, new.unionByName(points.join(new.select("key", "tier", "ts"), ["key", "tier", "ts"], "left_anti").select(*new.columns)), results
