"""Stores: a table pair, and stores made of other stores."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import glob
from tidemark.operators import catalog as cat
from tidemark.operators import ingest, read
from tidemark.plans.frame import Series

NOT_ALLOWED = "writes not allowed"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back.

    ``spark.checkpoint.dir`` names that folder; only where it is unset, a folder of the
    warehouse is used.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{top.rstrip('/')}/store-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Store:
    """A catalogue and its points.  Operations replace the frames; results are frames of errors.

    One operation stays a lazy plan.  Before the next one changes the frames, they are
    written and read back, so that plans do not grow from operation to operation.
    """

    catalog: DataFrame
    points: DataFrame
    rules: list[ingest.Rule] = field(default_factory=list)
    events: DataFrame | None = None
    conflict: str = "oldest"
    pending: bool = False

    def _begin(self) -> None:
        if self.pending:
            self.catalog, self.points = settled(self.catalog), settled(self.points)
        self.pending = True

    @classmethod
    def empty(cls, spark: SparkSession, rules: list[ingest.Rule] = ()) -> "Store":
        return cls(spark.createDataFrame([], cat.CATALOG), spark.createDataFrame([], cat.POINTS), list(rules))

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def write(self, batch: DataFrame, now: int) -> DataFrame:
        if "arrival" not in batch.columns:
            batch = batch.withColumn("arrival", F.monotonically_increasing_id())
        self._begin()
        self.catalog, self.points, out = ingest.write(self.catalog, self.points, batch, self.rules, now, self.conflict)
        return out

    def update_metadata(self, changes: DataFrame, behavior: int = cat.UPDATE, create_new: bool = True, now: int | None = None) -> DataFrame:
        self._begin()
        self.catalog, self.points, out = cat.update_metadata(self.catalog, self.points, changes, behavior, create_new, now)
        return out

    def delete_series(self, patterns: list[str]) -> DataFrame:
        self._begin()
        self.catalog, self.points, out = cat.delete_series(self.catalog, self.points, patterns)
        return out

    def rename_series(self, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> DataFrame:
        self._begin()
        self.catalog, self.points, out = cat.rename_series(self.catalog, self.points, names, merge, now)
        return out

    def drop_keys(self, keys: DataFrame) -> None:
        """Delete the series named in ``keys`` (key)."""
        self._begin()
        self.catalog, self.points = (f.join(keys, "key", "left_anti") for f in (self.catalog, self.points))

    def find(self, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
        return cat.find(self.catalog, patterns)

    def read(self, patterns: list[str], start: int, end: int, now: int) -> tuple[DataFrame, DataFrame]:
        return read.read(self.catalog, self.points, patterns, start, end, now)

    def read_all(self, key: str) -> tuple[DataFrame, DataFrame]:
        return read.read_all(self.catalog, self.points, key)

    def read_series(self, pattern: str, start: int, end: int, now: int, keep=None) -> Series:
        return read.series(self.catalog, self.points, pattern, start, end, now, keep)

    def stats(self) -> DataFrame:
        """name, value: counts of series, points and points by tier."""
        a = self.catalog.agg(F.count("*").alias("value")).select(F.lit("series").alias("name"), "value")
        b = self.points.groupBy("tier").agg(F.count("*").alias("value")).select(F.concat(F.lit("points.tier"), F.col("tier").cast("string")).alias("name"), "value")
        return a.unionByName(b)


class ReadOnlyStore(Store):
    """Reads pass; every write is an error."""

    def _refuse(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", F.lit(NOT_ALLOWED).alias("error"), F.lit(False).alias("ignored")).distinct()

    def write(self, batch, now):
        return self._refuse(batch)

    def update_metadata(self, changes, behavior=cat.UPDATE, create_new=True, now=None):
        return self._refuse(changes)

    def delete_series(self, patterns):
        return self._refuse(self.spark.createDataFrame([(p,) for p in patterns], "key string"))

    def rename_series(self, names, merge=False, now=None):
        return self._refuse(self.spark.createDataFrame([(a,) for a, _ in names], "key string"))


class EmptyStore(Store):
    """Writes succeed and vanish; there is nothing to read or rename."""

    def write(self, batch, now):
        return batch.select("key", F.lit("").alias("error"), F.lit(False).alias("ignored")).distinct()

    def update_metadata(self, changes, behavior=cat.UPDATE, create_new=True, now=None):
        return changes.select("key", F.lit("").alias("error"), F.lit(False).alias("ignored"))


def combined_results(parts: list[DataFrame]) -> DataFrame:
    """One outcome a key: an error beats a success, a success beats an ignored one."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    rank = F.when((F.col("error") != "") & ~F.col("ignored"), 2).when(F.col("error") == "", 1).otherwise(0)
    top = F.max_by(F.struct("error", "ignored"), rank)
    return all_.groupBy("key").agg(top.alias("t")).select("key", "t.error", "t.ignored")


@dataclass
class MultiStore:
    """Replicas: everything goes to all, reads are merged."""

    stores: list[Store]
    events: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.stores[0].spark

    def write(self, batch: DataFrame, now: int) -> DataFrame:
        return combined_results([s.write(batch, now) for s in self.stores])

    def update_metadata(self, changes, **how) -> DataFrame:
        return combined_results([s.update_metadata(changes, **how) for s in self.stores])

    def delete_series(self, patterns: list[str]) -> DataFrame:
        parts = [s.delete_series(patterns) for s in self.stores]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("pattern").agg(F.sum("deleted").alias("deleted"))

    def find(self, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
        found = [s.find(patterns) for s in self.stores]
        rows, errors = found[0]
        for r, e in found[1:]:
            rows, errors = rows.unionByName(r), errors.unionByName(e)
        worst = errors.groupBy("pattern").agg(F.max("error").alias("error"))
        return rows.distinct().join(worst.where("error <> ''"), "pattern", "left_anti"), worst

    def read(self, patterns: list[str], start: int, end: int, now: int) -> tuple[DataFrame, DataFrame]:
        parts = [s.read(patterns, start, end, now) for s in self.stores]
        return read.merge_reads([h for h, _ in parts], [d for _, d in parts])

    def rename_series(self, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> DataFrame:
        return combined_results([s.rename_series(names, merge=merge, now=now) for s in self.stores])

    def read_all(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Of the one store that has the key; an error if several have it."""
        parts = [s.read_all(key) for s in self.stores]
        have = [p for p in parts if not p[0].isEmpty()]
        if len(have) > 1:
            raise ValueError("more than one store has the series")
        return (have or parts)[0]

    def stats(self) -> DataFrame:
        out = self.stores[0].stats()
        for s in self.stores[1:]:
            out = out.unionByName(s.stats())
        return out.groupBy("name").agg(F.sum("value").alias("value"))

    def read_series(self, pattern: str, start: int, end: int, now: int, keep=None) -> Series:
        parts = [s.read_series(pattern, start, end, now, keep) for s in self.stores]
        dim, pts = parts[0].dim.withColumn("_s", F.lit(0)), parts[0].pts
        for k, p in enumerate(parts[1:], 1):
            dim, pts = dim.unionByName(p.dim.withColumn("_s", F.lit(k))), pts.unionByName(p.pts)
        first = dim.groupBy("sid").agg(F.min_by(F.struct(*parts[0].dim.columns[1:]), "_s").alias("d")).select("sid", "d.*")
        return Series(first, pts.groupBy("sid", "ts").agg(F.first("value", True).alias("value")))


def ring(stores: list[tuple[str, str]], replicas: int = 100) -> list[tuple[int, int]]:
    """Sorted (position, store number) of a consistent hash ring.

    A position is the first two bytes of the md5 of ``('host', 'name'):i``; where two
    stores meet, the first to come stays.
    """
    import hashlib

    out: dict[int, int] = {}
    for k, (host, name) in enumerate(stores):
        for i in range(replicas):
            out.setdefault(int(hashlib.md5(f"('{host}', '{name}'):{i}".encode()).hexdigest()[:4], 16), k)
    return sorted(out.items())


def placement_table(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """position (0..65535), store: the ring spelled out, for an equi-join on a key's position."""
    rows, k = [], 0
    for p in range(65536):
        while k < len(points) and points[k][0] < p:
            k += 1
        rows.append((p, points[k % len(points)][1]))
    return spark.createDataFrame(rows, "position int, store int")


def place_keys(keys: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """``keys`` with the number of the store each belongs to; the table of 65536 rows is broadcast."""
    at = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    return keys.withColumn("position", at).join(F.broadcast(placement_table(keys.sparkSession, points)), "position").drop("position")


def verify(actual: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """Moves (key, store, wanted) of the keys that are not where the ring puts them.  ``actual``: key, store."""
    wanted = place_keys(actual.select("key").distinct(), points).withColumnRenamed("store", "wanted")
    return actual.join(wanted, "key").where("store <> wanted")


@dataclass
class RingStore(MultiStore):
    """Stores that share the keys by a consistent hash ring.

    Writes and literal names go to the store that the ring names, patterns to all.  With
    ``read_from_all`` literal reads ask every store, as they must while keys may be misplaced.
    """

    places: list[tuple[str, str]] = field(default_factory=list)
    read_from_all: bool = False

    def __post_init__(self):
        self.points_of_ring = ring(self.places)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, ...) with the number of the store each belongs to."""
        return place_keys(rows, self.points_of_ring)

    def _routed(self, rows: DataFrame, call) -> DataFrame:
        own = settled(self.placed(rows))
        parts = [call(s, own.where(F.col("store") == k).drop("store")) for k, s in enumerate(self.stores)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, batch: DataFrame, now: int) -> DataFrame:
        if "arrival" not in batch.columns:
            batch = batch.withColumn("arrival", F.monotonically_increasing_id())
        return self._routed(batch, lambda s, rows: s.write(rows, now))

    def update_metadata(self, changes: DataFrame, **how) -> DataFrame:
        return self._routed(changes, lambda s, rows: s.update_metadata(rows, **how))

    def _of(self, names: list[str]) -> dict[str, int]:
        rows = self.placed(self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "key string")).collect()
        return {r["key"]: r["store"] for r in rows}

    def read(self, patterns: list[str], start: int, end: int, now: int) -> tuple[DataFrame, DataFrame]:
        literals = [p for p in patterns if not glob.is_pattern(p)]
        if self.read_from_all or not literals:
            return super().read(patterns, start, end, now)
        of = self._of(literals)
        parts = []
        for k, s in enumerate(self.stores):
            own = [p for p in patterns if of.get(p, k) == k]
            if own:
                parts.append(s.read(own, start, end, now))
        return read.merge_reads([h for h, _ in parts], [d for _, d in parts])

    def rename_series(self, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> DataFrame:
        """Renames inside a store are its own; others copy the series to the new name's store and then delete it."""
        of = self._of([n for pair in names for n in pair])
        parts = []
        for k, s in enumerate(self.stores):
            own = [(a, b) for a, b in names if of[a] == k and of[b] == k]
            if own:
                parts.append(s.rename_series(own, merge=merge, now=now))
            for j, other in enumerate(self.stores):
                across = [(a, b) for a, b in names if of[a] == k and of[b] == j and j != k]
                if across:
                    parts.append(moved_series(s, other, self.spark.createDataFrame(across, "key string, new_key string"), merge, now))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def verify(self, repair: bool = False, now: int | None = None) -> DataFrame:
        """Moves (key, store, wanted) of keys that stand in another store than the ring's; ``repair`` carries them out.

        A moved series keeps the archives of a series that its store has already; its points win.
        """
        actual = self.stores[0].catalog.select("key", F.lit(0).alias("store"))
        for k, s in enumerate(self.stores[1:], 1):
            actual = actual.unionByName(s.catalog.select("key", F.lit(k).alias("store")))
        out = settled(verify(actual, self.points_of_ring))
        if repair:
            for r in out.select("store", "wanted").distinct().orderBy("store", "wanted").collect():
                keys = out.where((F.col("store") == r["store"]) & (F.col("wanted") == r["wanted"])).select("key", F.col("key").alias("new_key"))
                moved_series(self.stores[r["store"]], self.stores[r["wanted"]], keys, True, now)
        return out


def moved_series(source: Store, target: Store, names: DataFrame, merge: bool, now: int | None) -> DataFrame:
    """Take series (key, new_key) from one store to another; results per old name.

    A series that the target has stays as it is without ``merge``; with it, it keeps its
    archives and takes the source's points, which win their slots.
    """
    have = source.catalog.select("key", F.lit(True).alias("_src"))
    taken = target.catalog.select(F.col("key").alias("new_key"), F.lit(True).alias("_dst"))
    r = names.join(have, "key", "left").join(taken, "new_key", "left")
    error = (
        F.when(~F.col("new_key").rlike(glob.KEY), "key contains invalid characters")
        .when(F.col("_src").isNull(), "series does not exist")
        .when(F.col("_dst").isNotNull() & F.lit(not merge), "destination exists")
        .otherwise("")
    )
    r = settled(r.select("key", "new_key", error.alias("error")))
    go = r.where("error = ''").select("key", "new_key")
    renamed = lambda f: f.join(go, "key").withColumn("key", F.col("new_key")).select(*f.columns)
    rows, points = settled(renamed(source.catalog)), settled(renamed(source.points).where("value IS NOT NULL"))
    at = now if now is not None else cat._latest(points)
    target.update_metadata(rows, behavior=cat.IGNORE, create_new=True, now=at)
    target.write(points.select("key", "ts", "value", (-F.col("tier")).cast("bigint").alias("arrival")), at)
    source.drop_keys(go.select("key"))
    return r.select("key", "error", (F.col("error") == "destination exists").alias("ignored"))
