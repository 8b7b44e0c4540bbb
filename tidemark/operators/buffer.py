"""A write buffer in front of a store.

Writes and metadata changes are queued and succeed at once; ``flush`` hands them to the
store, in key order and a bounded number of keys at a time if asked.  Reads and finds see
the queue laid over the store.

    points: key, ts, value, call, arrival    -- the last arrival of a (key, ts) wins
    meta  : key, archives, xff, agg, behavior, create_new    -- one row a key
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import glob
from tidemark.operators import catalog as cat
from tidemark.operators import ingest
from tidemark.operators.stores import Store, settled
from tidemark.plans.frame import Series, shaped

POINTS = "key string, ts bigint, value double, call bigint, arrival bigint"
META = f"{cat.CATALOG}, behavior int, create_new boolean"


def latest(points: DataFrame) -> DataFrame:
    """One row for each key and second: the one that arrived last."""
    top = F.max_by(F.struct("value", "call", "arrival"), F.struct("call", "arrival")).alias("p")
    return points.groupBy("key", "ts").agg(top).select("key", "ts", "p.*")


def queued(meta: DataFrame, changes: DataFrame, points: DataFrame, behavior: int, create_new: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New metadata queue, new points and results of ``changes`` (a catalogue row a key).

    Recreate drops the key's queued points; Ignore leaves a key that is queued in any
    way alone; Update never takes a queued Recreate back.
    """
    has = points.select("key").unionByName(meta.select("key")).distinct().withColumn("_has", F.lit(True))
    old = meta.select("key", F.col("behavior").alias("_behavior"), F.col("create_new").alias("_create"))
    c = changes.join(has, "key", "left").join(old, "key", "left")
    ignored = F.col("_has").isNotNull() & F.lit(behavior == cat.IGNORE)
    results = c.select("key", F.when(ignored, "the key has queued commands").otherwise("").alias("error"), ignored.alias("ignored"))
    done = c.where(~ignored)
    kept = F.when(F.col("_behavior") == cat.RECREATE, cat.RECREATE).otherwise(behavior) if behavior == cat.UPDATE else F.lit(behavior)
    new = done.select("key", "archives", "xff", "agg", kept.cast("int").alias("behavior"), (F.coalesce("_create", F.lit(False)) | F.lit(create_new)).alias("create_new"))
    out = meta.join(done.select("key"), "key", "left_anti").unionByName(new)
    return out, points.join(done.select("key"), "key", "left_anti") if behavior == cat.RECREATE else points, results


def under(points: DataFrame, meta: DataFrame, old_points: DataFrame, old_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with older commands merged under it.

    An older change holds where there is none or only an Ignore; an older Recreate makes
    a newer Update recreate.  Older points fill seconds that have none, unless the newer
    change recreates the series.
    """
    old = old_meta.select("key", *(F.col(c).alias(f"_{c}") for c in old_meta.columns[1:]), F.lit(True).alias("_old"))
    both = meta.withColumn("_new", F.lit(True)).join(old, "key", "outer")
    take = F.col("_new").isNull() | (F.col("_old").isNotNull() & (F.col("behavior") == cat.IGNORE))
    again = F.col("_old").isNotNull() & (F.col("behavior") == cat.UPDATE) & (F.col("_behavior") == cat.RECREATE)
    pick = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in meta.columns[1:]}
    pick["behavior"] = F.when(take, F.col("_behavior")).when(again, cat.RECREATE).otherwise(F.col("behavior")).cast("int")
    merged = both.select("key", *(v.alias(c) for c, v in pick.items()))
    wiped = meta.where(F.col("behavior") == cat.RECREATE).select("key")
    more = old_points.join(wiped, "key", "left_anti").join(points.select("key", "ts"), ["key", "ts"], "left_anti")
    return points.unionByName(more.select(*points.columns)), merged


@dataclass
class BufferedStore:
    """``store`` with a queue in front.

    ``find_patterns=False`` leaves the queue out of finds by pattern; ``deferred`` lets
    ``delete_series(..., defer=True)`` wait for ``run_deletes``.  ``recoverable`` tells from
    a write's results which failed keys go back into the queue.
    """

    store: Store
    find_patterns: bool = True
    deferred: bool = True
    recoverable: Column | None = None
    points: DataFrame | None = None
    meta: DataFrame | None = None
    position: str = ""
    calls: int = 0
    deletes: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.points is None:
            self.points = self.spark.createDataFrame([], POINTS)
        if self.meta is None:
            self.meta = self.spark.createDataFrame([], META)

    @property
    def spark(self):
        return self.store.spark

    @property
    def events(self):
        return self.store.events

    def _settle(self) -> None:
        self.points, self.meta = settled(self.points), settled(self.meta)

    def write(self, batch: DataFrame, now: int) -> DataFrame:
        """Queue key, ts, value (and arrival); every key succeeds."""
        if "arrival" not in batch.columns:
            batch = batch.withColumn("arrival", F.monotonically_increasing_id())
        self.calls += 1
        new = batch.select("key", F.col("ts").cast("bigint").alias("ts"), F.col("value").cast("double").alias("value"), F.lit(self.calls).cast("bigint").alias("call"), F.col("arrival").cast("bigint").alias("arrival"))
        self.points = latest(self.points.unionByName(new))
        self._settle()
        return batch.select("key", F.lit("").alias("error"), F.lit(False).alias("ignored")).distinct()

    def update_metadata(self, changes: DataFrame, behavior: int = cat.UPDATE, create_new: bool = True, now: int | None = None) -> DataFrame:
        self.meta, self.points, out = queued(self.meta, changes.select("key", "archives", "xff", "agg"), self.points, behavior, create_new)
        out = settled(out)
        self._settle()
        return out

    def waiting(self) -> DataFrame:
        """key of every series with queued commands."""
        return self.points.select("key").unionByName(self.meta.select("key")).distinct()

    def flush(self, now: int, keys: int | None = None) -> DataFrame:
        """Hand queued commands to the store: all, or those of the next ``keys`` keys in key order.

        A bounded flush goes on where the one before ended, and from the first key after the
        last.  The write's results; what failed and can be tried again is queued under
        newer commands.
        """
        if keys is None:
            points, meta = self.points, self.meta
            self.points, self.meta, self.position = points.limit(0), meta.limit(0), ""
        else:
            some = [r["key"] for r in self.waiting().where(F.col("key") >= self.position).orderBy("key").limit(keys + 1).collect()]
            self.position = some[keys] if len(some) > keys else ""
            own = self.spark.createDataFrame([(k,) for k in some[:keys]], "key string")
            points, meta = (settled(f.join(F.broadcast(own), "key", "left_semi")) for f in (self.points, self.meta))
            self.points, self.meta = (f.join(F.broadcast(own), "key", "left_anti") for f in (self.points, self.meta))
        for r in meta.select("behavior", "create_new").distinct().orderBy("behavior", "create_new").collect():
            same = meta.where((F.col("behavior") == r["behavior"]) & (F.col("create_new") == r["create_new"]))
            self.store.update_metadata(same.select("key", "archives", "xff", "agg"), behavior=r["behavior"], create_new=r["create_new"], now=now)
        out = settled(self.store.write(points.select("key", "ts", "value", "arrival"), now))
        if self.recoverable is not None:
            back = out.where((F.col("error") != "") & ~F.col("ignored") & self.recoverable).select("key")
            self.points, self.meta = under(self.points, self.meta, points.join(back, "key", "left_semi"), meta.limit(0))
        self._settle()
        return out

    def _creates(self) -> DataFrame:
        """key, first step and behavior of queued changes."""
        return self.meta.select("key", F.get("archives", F.lit(0))["precision"].cast("bigint").alias("first_step"), "behavior", "create_new")

    def read(self, patterns: list[str], start: int, end: int, now: int) -> tuple[DataFrame, DataFrame]:
        """As the store's read, with queued points laid over it.

        Of a series that a queued command will create or recreate only the queued points
        count, on the first step of its new archives and whatever their time.  Elsewhere
        queued points with start <= ts <= end take their slot.  The newest second of a slot wins.
        """
        head, data = self.store.read(patterns, start, end, now)
        rules = getattr(self.store, "rules", [])
        auto = ingest.created(head.select(F.col("name").alias("key")).distinct(), rules) if rules else None
        h = head.join(self._creates().withColumnRenamed("key", "name"), "name", "left")
        if auto is not None:
            h = h.join(auto.select(F.col("key").alias("name"), F.get("archives", F.lit(0))["precision"].cast("bigint").alias("auto_step")), "name", "left")
        else:
            h = h.withColumn("auto_step", F.lit(None).cast("bigint"))
        anew = F.coalesce((F.col("behavior") == cat.RECREATE) | (F.col("create_new") & (F.col("step") == 0)), F.lit(False))
        h = h.withColumn("anew", anew).withColumn("slot_step", F.when(F.col("anew"), F.col("first_step")).when(F.col("step") > 0, F.col("step")).otherwise(F.col("auto_step")))
        p = self.points.select(F.col("key").alias("name"), "ts", F.col("value").alias("new_value"))
        p = h.where("slot_step > 0").select("query", "name", "slot_step", "anew").join(p, "name").where(F.col("anew") | F.col("ts").between(start, end))
        p = p.withColumn("slot", F.col("ts") - F.pmod("ts", "slot_step")).groupBy("query", "name", "slot").agg(F.max_by("new_value", "ts").alias("value"))
        top = p.select("query", "name", F.col("slot").alias("ts"), "value")
        stored = data.join(h.where("anew").select("query", "name"), ["query", "name"], "left_anti").join(top.select("query", "name", "ts"), ["query", "name", "ts"], "left_anti")
        rows = top.unionByName(stored.select("query", "name", "ts", "value"))
        span = rows.join(top.select("query", "name").distinct(), ["query", "name"], "left_semi").groupBy("query", "name").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        h = h.join(span, ["query", "name"], "left")
        snap = lambda x: F.lit(x) + F.col("slot_step") - F.pmod(F.lit(x), F.col("slot_step"))
        bound = lambda own, x, c: F.when(F.col("first").isNotNull(), F.col(own)).when(F.col("anew"), snap(x)).otherwise(F.col(c)).cast("bigint").alias(c)
        step = F.when(F.col("anew") | F.col("first").isNotNull(), F.col("slot_step")).otherwise(F.col("step")).cast("bigint").alias("step")
        return h.select("query", "name", step, bound("first", start, "start_time"), bound("last", end, "end_time")), rows

    def read_series(self, pattern: str, start: int, end: int, now: int, keep=None) -> Series:
        head, data = self.read([pattern], start, end, now)
        if keep is not None:
            left = keep(self.store.catalog).select(F.col("key").alias("name"))
            head, data = head.join(left, "name", "left_semi"), data.join(left, "name", "left_semi")
        sid = F.xxhash64("name").alias("sid")
        inside = head.where("step > 0").join(data.groupBy("name").agg(F.max("ts").alias("last")), "name", "left")
        over = F.greatest("end_time", F.coalesce(F.col("last") + F.col("step"), F.col("end_time")))
        dim = inside.select(sid, "name", "start_time", over.alias("end_time"), "step", F.expr("cast(map() as map<string,string>)").alias("tags"))
        return Series(shaped(dim), data.select(sid, "ts", F.nanvl("value", F.lit(None).cast("double")).alias("value")))

    def read_all(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Of the store alone: repair, which uses it, must not move points that are queued."""
        return self.store.read_all(key)

    def find(self, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
        """As the store's find; series that queued commands will create, and their directories, are found too."""
        found, errors = self.store.find(patterns)
        globs = [p for p in patterns if glob.is_pattern(p)]
        literals = [p for p in patterns if not glob.is_pattern(p)]
        out = found
        if globs and self.find_patterns:
            new = cat.find(self.meta.where("create_new"), globs)[0]
            out = out.unionByName(new).distinct()
        if literals:
            asked = self.spark.createDataFrame([(p,) for p in literals], "pattern string").join(found.select("pattern"), "pattern", "left_anti")
            out = out.unionByName(asked.join(self.waiting().withColumnRenamed("key", "pattern"), "pattern", "left_semi").select("pattern", F.col("pattern").alias("name"), F.lit(False).alias("is_directory")))
        bad = errors.where("error <> ''").select("pattern")
        return out.join(bad, "pattern", "left_anti"), errors

    def delete_series(self, patterns: list[str], defer: bool = False) -> DataFrame:
        """(pattern, deleted, buffer_deleted): series deleted in the store and from the queue."""
        gone = settled(cat.resolve(self.waiting(), patterns).join(self.waiting(), "key", "left_semi"))
        self.points, self.meta = (f.join(gone.select("key").distinct(), "key", "left_anti") for f in (self.points, self.meta))
        self._settle()
        counts = gone.groupBy("pattern").agg(F.count("*").alias("buffer_deleted"))
        if defer and self.deferred:
            self.deletes += patterns
            below = self.spark.createDataFrame([(p, 0) for p in patterns], "pattern string, deleted bigint")
        else:
            below = self.store.delete_series(patterns)
        return below.join(counts, "pattern", "left").select("pattern", "deleted", F.coalesce("buffer_deleted", F.lit(0)).alias("buffer_deleted"))

    def run_deletes(self) -> DataFrame:
        """Carry out the deletes that were put off."""
        patterns, self.deletes = list(dict.fromkeys(self.deletes)), []
        return self.store.delete_series(patterns)

    def rename_series(self, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> DataFrame:
        """Rename in the store; queued commands move with each name that could be renamed, under those of the new name."""
        out = settled(self.store.rename_series(names, merge=merge, now=now))
        done = self.spark.createDataFrame(names, "key string, new_key string").join(out.where("error = ''").select("key"), "key", "left_semi").where("key <> new_key")
        done = settled(done)
        swap = lambda f: f.join(done, "key").withColumn("key", F.col("new_key")).select(*f.columns)
        rest = [f.join(done.select("key"), "key", "left_anti") for f in (self.points, self.meta)]
        self.points, self.meta = under(*rest, swap(self.points), swap(self.meta))
        self._settle()
        return out

    def stats(self) -> DataFrame:
        """The store's stats, and the sizes of the queue."""
        sizes = ((self.points, "queued_writes", F.countDistinct("key")), (self.points, "queued_points", F.count("*")), (self.meta, "queued_updates", F.count("*")))
        out = self.store.stats()
        for frame, name, value in sizes:
            out = out.unionByName(frame.agg(value.alias("value")).select(F.lit(f"buffer.{name}").alias("name"), "value"))
        return out


def rate_limited(budget: int, per_seconds: float, used: list[float], now: float) -> float:
    """Seconds to wait before an action may run when at most ``budget`` may in a window; ``used`` keeps the times of past ones."""
    window = now - now % per_seconds
    used[:] = [t for t in used if t >= window]
    if len(used) < budget:
        used.append(now)
        return 0.0
    return window + per_seconds - now

