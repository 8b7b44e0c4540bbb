"""Parquet layout of a store: buckets of keys, a folder for each commit, and a manifest of the live files.

A commit writes only the buckets that it touches, each as a whole, into a folder of its
own; the manifest says which commit holds each bucket now.  Points are sorted by tier,
key and time inside a file, so that a read skips row groups by key and time.  Folders are
complete before the manifest appears, so a job that dies leaves the old state whole;
manifests are created, never replaced, so that of two writers who start from the same
state the second one fails and can start again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog as cat
from tidemark.operators.stores import Store

#: Buckets of a new store.
BUCKETS = 64


class ConflictError(RuntimeError):
    """Another writer has committed meanwhile."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that have a manifest, in order."""
    fs, p = _fs(spark, f"{path}/live")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def version(spark: SparkSession, path: str) -> int:
    """Number of the live commit; 0 if there is none."""
    return max(versions(spark, path), default=0)


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    """``buckets`` (their number) and ``at`` (bucket to the commit that wrote it)."""
    rows = spark.read.option("wholetext", True).text(f"{path}/live/{number}").collect()
    m = json.loads(rows[0][0])
    return {"buckets": m["buckets"], "at": {int(b): v for b, v in m["at"].items()}}


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _publish(spark: SparkSession, path: str, number: int, m: dict) -> None:
    fs, p = _fs(spark, f"{path}/live/{number}")
    fs.mkdirs(p.getParent())
    if fs.exists(p):
        raise ConflictError(f"commit {number} exists")
    # written aside and renamed, so that a manifest is never seen half
    _, aside = _fs(spark, f"{path}/tmp/{number}-{spark._jvm.java.util.UUID.randomUUID()}")
    fs.mkdirs(aside.getParent())
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(m).encode()))
    finally:
        out.close()
    if not fs.rename(aside, p):
        raise ConflictError(f"commit {number} exists")


def _write(catalog: DataFrame, points: DataFrame, at: str, buckets: int) -> None:
    own = bucket_of(buckets).alias("bucket")
    # ranges: a file holds one bucket, and a large bucket is several files
    catalog.select("*", own).repartitionByRange("bucket", "key").write.partitionBy("bucket").parquet(f"{at}/catalog")
    points.select("*", own).repartitionByRange("bucket", "tier", "key").sortWithinPartitions("bucket", "tier", "key", "ts").write.partitionBy("bucket").parquet(f"{at}/points")


def save(store: Store, path: str, buckets: int | None = None) -> int:
    """Write a whole store as a new commit; the number of the commit."""
    spark = store.spark
    n = version(spark, path) + 1
    buckets = buckets or BUCKETS
    _write(store.catalog, store.points, f"{path}/v{n}", buckets)
    _publish(spark, path, n, {"buckets": buckets, "at": {b: n for b in range(buckets)}})
    return n


def _part(spark: SparkSession, path: str, kind: str, schema: str, at: dict[int, int], some: list[int] | None) -> DataFrame:
    """Rows of some buckets (None: all) from the commits that hold them; a commit has no folder of a bucket without rows."""
    paths = []
    for b, v in sorted(at.items()):
        if some is None or b in some:
            fs, p = _fs(spark, f"{path}/v{v}/{kind}/bucket={b}")
            if fs.exists(p):
                paths.append(str(p))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, rules=(), number: int | None = None, buckets: list[int] | None = None) -> Store:
    """The store as of a commit (the live one if not given), or only some buckets of it."""
    n = number or version(spark, path)
    if not n:
        return Store.empty(spark, list(rules))
    at = manifest(spark, path, n)["at"]
    return Store(_part(spark, path, "catalog", cat.CATALOG, at, buckets), _part(spark, path, "points", cat.POINTS, at, buckets), list(rules))


def commit(spark: SparkSession, path: str, batch: DataFrame, now: int, rules=(), conflict: str = "oldest") -> int:
    """Write a batch (key, ts, value, arrival) into the store under ``path``; only the buckets of its keys are read and rewritten."""
    n = version(spark, path)
    m = manifest(spark, path, n) if n else {"buckets": BUCKETS, "at": {}}
    touched = sorted(r[0] for r in batch.select(bucket_of(m["buckets"])).distinct().collect())
    if not touched:
        return n
    s = load(spark, path, rules, n, touched) if n else Store.empty(spark, list(rules))
    s.conflict = conflict
    s.write(batch, now)
    _write(s.catalog, s.points, f"{path}/v{n + 1}", m["buckets"])
    _publish(spark, path, n + 1, {"buckets": m["buckets"], "at": m["at"] | {b: n + 1 for b in touched}})
    return n + 1


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete manifests older than the last ``keep`` and the folders of buckets that no manifest left refers to."""
    numbers = versions(spark, path)
    old, live = numbers[:-keep], numbers[-keep:]
    used = {(v, b) for n in live for b, v in manifest(spark, path, n)["at"].items()}
    gone = []
    for n in old:
        for b, v in manifest(spark, path, n)["at"].items():
            if (v, b) not in used:
                for kind in ("catalog", "points"):
                    fs, p = _fs(spark, f"{path}/v{v}/{kind}/bucket={b}")
                    if fs.delete(p, True):
                        gone.append(str(p))
        fs, p = _fs(spark, f"{path}/live/{n}")
        fs.delete(p, False)
    return gone


def compact(store: Store, now: int) -> Store:
    """Drop points that are older than their tier keeps."""
    tier = F.get("archives", F.col("tier"))
    kept = store.points.join(store.catalog.select("key", "archives"), "key").where(F.col("ts") > now - tier["precision"].cast("bigint") * tier["points"])
    return Store(store.catalog, kept.select(*store.points.columns), store.rules, store.events, store.conflict)
