"""The catalogue of series: find, create, update, rename, delete.

    catalog: key, archives array<struct<precision:int,points:int>>, xff double, agg int
    points : key, tier, step, ts, value

Operations take and return frames; errors are rows (key or pattern, description,
ignored) and never stop the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import glob

CATALOG = "key string, archives array<struct<precision:int,points:int>>, xff double, agg int"
POINTS = "key string, tier int, step int, ts bigint, value double"
RESULT = "key string, error string, ignored boolean"


def nodes(key: Column) -> Column:
    return F.split(key, r"\.")


def _parts(pattern: str) -> list[str]:
    """Components; a dot inside a group does not split (and can then match nothing)."""
    return pattern.split(".")


def find(catalog: DataFrame, patterns: list[str], **how) -> tuple[DataFrame, DataFrame]:
    """(pattern, name, is_directory) and (pattern, error).

    A pattern of n components matches series of n components and, as ``path.*``,
    directories of n components; ``prefix.**`` matches every series below the prefix and
    no directory.  ``**`` elsewhere is an error.
    """
    spark, out, errors = catalog.sparkSession, None, []
    keys = catalog.select("key")
    n = nodes(F.col("key"))
    for p in patterns:
        try:
            if glob.is_indeterminate(p):
                prefix = p[:-2]
                if p != "**" and not p.endswith(".**") or "**" in prefix:
                    raise glob.PatternError("** is only allowed as the last component")
                cond = F.lit(True)
                if prefix:
                    parts = _parts(prefix[:-1])
                    cond = F.size(n) > len(parts)
                    for i, c in enumerate(parts):
                        cond = cond & glob.condition(F.get(n, F.lit(i)), c, **how)
                    if glob.literal_prefix(prefix):
                        cond = cond & F.col("key").startswith(glob.literal_prefix(prefix))
                rows = keys.where(cond).select(F.lit(p).alias("pattern"), F.col("key").alias("name"), F.lit(False).alias("is_directory"))
            else:
                parts = _parts(p)
                cond = F.size(n) >= len(parts)
                if glob.literal_prefix(p):
                    cond = cond & F.col("key").startswith(glob.literal_prefix(p))
                for i, c in enumerate(parts):
                    cond = cond & glob.condition(F.get(n, F.lit(i)), c, **how)
                leaf = F.size(n) == len(parts)
                name = F.when(leaf, F.col("key")).otherwise(F.concat(F.concat_ws(".", F.slice(n, 1, len(parts))), F.lit(".*")))
                rows = keys.where(cond).select(F.lit(p).alias("pattern"), name.alias("name"), (~leaf).alias("is_directory")).distinct()
        except glob.PatternError as e:
            errors.append((p, str(e)))
            continue
        errors.append((p, ""))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "pattern string, name string, is_directory boolean")
    return out, spark.createDataFrame(errors, "pattern string, error string")


def resolve(catalog: DataFrame, patterns: list[str], **how) -> DataFrame:
    """(pattern, key) of series only; a literal passes through, also where no such series exists."""
    globs = [p for p in patterns if glob.is_pattern(p)]
    literals = [p for p in patterns if not glob.is_pattern(p)]
    out = find(catalog, globs, **how)[0].where(~F.col("is_directory")).select("pattern", F.col("name").alias("key"))
    if literals:
        out = out.unionByName(catalog.sparkSession.createDataFrame([(p, p) for p in literals], "pattern string, key string"))
    return out


UPDATE, IGNORE, RECREATE = 0, 1, 2


def update_metadata(catalog: DataFrame, points: DataFrame, changes: DataFrame, behavior: int = UPDATE, create_new: bool = True, now: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New catalogue, new points, and results.  ``changes`` has the catalogue's columns, a row per key.

    Update rewrites the points of a series whose archives change; Ignore leaves existing
    series; Recreate drops their points.  Missing series are created if ``create_new``.
    """
    ok = F.col("key").rlike(glob.KEY)
    old = catalog.select("key", F.lit(True).alias("_old"), F.col("archives").alias("_archives"))
    c = changes.join(old, "key", "left").withColumns({"_valid": ok, "_exists": F.coalesce("_old", F.lit(False))})
    error = (
        F.when(~F.col("_valid"), "key contains invalid characters")
        .when(F.col("_exists") & F.lit(behavior == IGNORE), "series already exists")
        .when(~F.col("_exists") & F.lit(not create_new), "series does not exist")
        .otherwise("")
    )
    c = c.withColumn("error", error)
    results = c.select("key", "error", (F.col("error") != "").alias("ignored"))
    done = c.where(F.col("error") == "")
    new_catalog = catalog.join(done.select("key"), "key", "left_anti").unionByName(done.select("key", "archives", F.when((F.col("xff") >= 0) & (F.col("xff") <= 1), F.col("xff")).otherwise(0.0).alias("xff"), "agg"))
    if behavior == RECREATE:
        return new_catalog, points.join(done.select("key"), "key", "left_anti"), results
    moved = done.where(F.col("_exists") & (F.to_json(F.struct("archives")) != F.to_json(F.struct(F.col("_archives").alias("archives"))))).select("key")
    return new_catalog, resample(new_catalog, points, moved, now), results


def resample(catalog: DataFrame, points: DataFrame, keys: DataFrame, now: int | None) -> DataFrame:
    """Rewrite the points of ``keys`` through the ingest path into their present archives; conflicts are not aggregated."""
    from tidemark.operators import ingest

    rest = points.join(keys, "key", "left_anti")
    raw = points.join(keys, "key", "left_semi").where("value IS NOT NULL").select("key", "ts", "value", (-F.col("tier")).cast("bigint").alias("arrival"))
    at = F.lit(now) if now is not None else None
    fresh = ingest.write(catalog.join(keys, "key", "left_semi"), points.limit(0), raw, [], now if at is not None else _latest(raw))[1]
    return rest.unionByName(fresh)


def _latest(raw: DataFrame) -> int:
    return int(raw.agg(F.max("ts")).first()[0] or 0)


def delete_series(catalog: DataFrame, points: DataFrame, patterns: list[str], **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New catalogue, new points, and (pattern, deleted).  A glob deletes matching series, ``p.**`` a whole subtree; directories stay otherwise."""
    found = resolve(catalog, patterns, **how).join(catalog.select("key"), "key", "left_semi")
    gone = found.select("key").distinct()
    asked = catalog.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    counts = asked.join(found.groupBy("pattern").agg(F.count("*").alias("deleted")), "pattern", "left").select("pattern", F.coalesce("deleted", F.lit(0)).cast("bigint").alias("deleted"))
    return catalog.join(gone, "key", "left_anti"), points.join(gone, "key", "left_anti"), counts


def rename_series(catalog: DataFrame, points: DataFrame, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New catalogue, new points, and results per old name.

    A destination that exists is an ignored error, or with ``merge`` keeps its archives and
    takes the source's points, which win their slots.  Names are literals.
    """
    spark = catalog.sparkSession
    names_df = spark.createDataFrame(names, "key string, new_key string")
    have = catalog.select("key", F.lit(True).alias("_h"))
    r = names_df.join(have, "key", "left").withColumnRenamed("_h", "_src")
    r = r.join(have.select(F.col("key").alias("new_key"), F.col("_h").alias("_dst")), "new_key", "left")
    pattern = F.col("key").rlike(r"[\[\]{}*]") | F.col("new_key").rlike(r"[\[\]{}*]")
    error = (
        F.when(pattern, "names cannot be patterns")
        .when(~F.col("new_key").rlike(glob.KEY), "key contains invalid characters")
        .when(F.col("_src").isNull(), "series does not exist")
        .when(F.col("key") == F.col("new_key"), "")
        .when(F.col("_dst").isNotNull() & F.lit(not merge), "destination exists")
        .otherwise("")
    )
    r = r.withColumn("error", error)
    results = r.select("key", "error", (F.col("error") == "destination exists").alias("ignored"))
    move = r.where((F.col("error") == "") & (F.col("key") != F.col("new_key"))).select("key", "new_key", F.col("_dst").isNotNull().alias("_dst"))
    plain, merged = move.where(~F.col("_dst")), move.where("_dst")
    swap = lambda df, m: df.join(m.select("key", "new_key"), "key").withColumn("key", F.col("new_key")).select(*df.columns)
    out_catalog = catalog.join(move.select("key"), "key", "left_anti").unionByName(swap(catalog, plain))
    out_points = points.join(move.select("key"), "key", "left_anti").unionByName(swap(points, plain))
    if merge:
        from tidemark.operators import ingest

        moved = swap(points, merged).where("value IS NOT NULL").select("key", "ts", "value", (-F.col("tier")).cast("bigint").alias("arrival"))
        out_points = ingest.write(out_catalog, out_points, moved, [], now if now is not None else _latest(moved))[1]
    return out_catalog, out_points, results
