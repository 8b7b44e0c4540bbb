"""Sets of series as two frames: a dimension row per series, and points in long form.

    dim: sid, name, ordinal, start_time, end_time, step, options, tags, group_key
    pts: sid, ts, value            -- no row, or a null, where there is no value

Names can repeat, so ``sid`` identifies a series.  Points never become columns: a glob
may match millions of series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

DIM = "sid bigint, name string, ordinal bigint, start_time bigint, end_time bigint, step bigint, options map<string,string>, tags map<string,string>, group_key string"
PTS = "sid bigint, ts bigint, value double"
DIM_COLUMNS = [c.split()[0] for c in DIM.split(", ")]


@dataclass
class Series:
    """``hinted``: a function of the query may have set the option xFilesFactor."""

    dim: DataFrame
    pts: DataFrame
    hinted: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.dim.sparkSession

    def with_dim(self, **cols: Column) -> "Series":
        return Series(self.dim.withColumns(cols), self.pts)

    def renamed(self, name: Column) -> "Series":
        return self.with_dim(name=name)

    def with_value(self, value: Column) -> "Series":
        """A new value from the columns sid, ts, value of each point."""
        return Series(self.dim, self.pts.select("sid", "ts", value.cast("double").alias("value")))

    def joined(self, *cols: str) -> DataFrame:
        """Points with columns of their series."""
        return self.pts.join(self.dim.select("sid", *cols), "sid")

    def dense(self, *cols: str) -> DataFrame:
        """A row for each step of each series, null where there is no value; ``i`` counts from 0."""
        d = self.dim.where("step > 0 AND end_time > start_time")
        keep = [c for c in cols if c not in ("start_time", "end_time", "step")]
        grid = d.select("sid", "start_time", "end_time", "step", *keep, F.posexplode(F.sequence("start_time", F.col("end_time") - F.col("step"), F.col("step"))).alias("i", "ts"))
        return grid.join(self.pts, ["sid", "ts"], "left")

    def only(self, sids: DataFrame) -> "Series":
        """The series whose sid is in ``sids``."""
        return Series(self.dim.join(sids.select("sid"), "sid", "left_semi"), self.pts.join(sids.select("sid"), "sid", "left_semi"))

    def stats(self, func: str) -> DataFrame:
        """sid, ordinal and stat of every series (null without points)."""
        s = self.pts.groupBy("sid").agg(consolidate(func).alias("stat"))
        return self.dim.select("sid", "ordinal", "name").join(s, "sid", "left")

    def result(self) -> DataFrame:
        """name, ts, value of all points that have a value."""
        return self.joined("name").where("value IS NOT NULL").select("name", "ts", "value")


def by_time(*more: str) -> WindowSpec:
    return Window.partitionBy("sid", *more).orderBy("ts")


def gcd(a: Column, b: Column) -> Column:
    step = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.when(x["b"] == 0, F.lit(1)).otherwise(x["b"])).alias("b")))
    start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["a"]


#: Spellings of the consolidation functions (fixed values).
SAME = {"avg": "average", "current": "last", "total": "sum", "rangeOf": "range", "stdev": "stddev", "mult": "multiply"}
SAME |= {f"{x}Series": x for x in ("average", "sum", "min", "max", "diff", "count", "multiply", "median", "stddev", "range", "last")} | {"avgSeries": "average", "rangeOfSeries": "range"}
FUNCTIONS = ("average", "count", "diff", "last", "first", "max", "median", "min", "multiply", "range", "stddev", "sum")


def canonical(func: str) -> str:
    f = SAME.get(func, func)
    if f not in FUNCTIONS:
        raise ValueError(f"unknown consolidation function {func!r}")
    return f


def consolidate(func: str, order: str = "ts", value: Column | None = None) -> Column:
    """Aggregate over values, nulls left out; ``order`` decides first, last and what diff subtracts from."""
    v = F.col("value") if value is None else value
    at = F.when(v.isNotNull(), F.col(order))
    match canonical(func):
        case "average":
            return F.avg(v)
        case "count":
            return F.count(v).cast("double")
        case "diff":
            return 2 * F.min_by(v, at) - F.sum(v)
        case "last":
            return F.max_by(v, at)
        case "first":
            return F.min_by(v, at)
        case "max":
            return F.max(v)
        case "median":
            return F.percentile(v, F.lit(0.5))
        case "min":
            return F.min(v)
        case "multiply":
            return F.product(v)
        case "range":
            return F.max(v) - F.min(v)
        case "stddev":
            return F.stddev_pop(v)
        case "sum":
            return F.sum(v)


def union(parts: list[Series]) -> Series:
    """All series one after another; the same series twice stays twice."""
    if len(parts) == 1:
        return parts[0]
    hinted = any(s.hinted for s in parts)
    dim = pts = None
    for k, s in enumerate(parts):
        sid = F.xxhash64("sid", F.lit(k)).alias("sid")
        d = s.dim.select(sid, "name", (F.col("ordinal") + F.lit(k << 40)).alias("ordinal"), *DIM_COLUMNS[3:])
        p = s.pts.select(sid, "ts", "value")
        dim, pts = (d, p) if dim is None else (dim.unionByName(d), pts.unionByName(p))
    return Series(dim, pts, hinted)


def factor() -> Column:
    """The option xFilesFactor of a series; 0 without one."""
    return F.coalesce(F.element_at("options", F.lit("xFilesFactor")).cast("double"), F.lit(0.0))


def consolidated(s: Series, most: int) -> Series:
    """At most ``most`` points a series: steps side by side become one by the option consolidateBy (average if not set).

    A wider step has a value where the share of known points reaches the option xFilesFactor.
    """
    if most < 1:
        raise ValueError("at least one point is needed")
    n = F.ceil((F.col("end_time") - F.col("start_time")) / F.col("step") / most)
    wide = s.dim.withColumn("_n", F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("bigint"))
    by = F.coalesce(F.element_at("options", F.lit("consolidateBy")), F.lit("average"))
    rows = s.pts.join(wide.select("sid", "start_time", "step", "_n", by.alias("_by"), factor().alias("_f")), "sid")
    rows = rows.withColumn("ts_", F.col("start_time") + F.floor((F.col("ts") - F.col("start_time")) / (F.col("step") * F.col("_n"))) * F.col("step") * F.col("_n"))
    v = F.lit(None).cast("double")
    for f in FUNCTIONS:
        v = F.when(F.first("_by") == f, consolidate(f)).otherwise(v)
    g = rows.groupBy("sid", F.col("ts_").alias("ts")).agg(v.alias("value"), F.count("value").alias("_k"), F.first("_n").alias("_n"), F.first("_f").alias("_f"))
    pts = g.where((F.col("_k") > 0) & (F.col("_k") >= F.col("_f") * F.col("_n"))).select("sid", "ts", "value")
    return Series(wide.withColumn("step", F.col("step") * F.col("_n")).select(*s.dim.columns), pts, s.hinted)


def header(dim: DataFrame, *by: str) -> DataFrame:
    """The merged header of (groups of) series: latest start, latest end, gcd of the steps."""
    steps = F.array_sort(F.collect_set("step"))
    step = F.aggregate(steps, F.lit(0).cast("bigint"), gcd)
    return dim.groupBy(*by).agg(F.max("start_time").alias("start_time"), F.max("end_time").alias("end_time"), step.alias("step"), F.min("ordinal").alias("ordinal"), F.count("*").alias("members"), F.max(factor()).alias("factor"))


def shaped(dim: DataFrame) -> DataFrame:
    """A dimension with all columns, defaults where there are none."""
    empty = F.expr("cast(map() as map<string,string>)")
    for c, v in (("ordinal", F.lit(0).cast("bigint")), ("options", empty), ("tags", empty), ("group_key", F.lit(None).cast("string"))):
        if c not in dim.columns:
            dim = dim.withColumn(c, v)
    return dim.select(*DIM_COLUMNS)


def combine(s: Series, func: str, name: Column | str, by: Column | None = None, xff: float | None = None) -> Series:
    """One series (or one per value of ``by``, a column over dim) from all values at each time."""
    key = F.coalesce(by.cast("string"), F.lit("")) if by is not None else F.lit("")
    dim = s.dim.withColumn("_g", key)
    out = header(dim, "_g").withColumn("sid", F.xxhash64("_g"))
    ordered = canonical(func) in ("diff", "last", "first")
    if by is None and not ordered:
        rows = s.pts.withColumn("_g", F.lit(""))
    else:
        rows = s.pts.join(dim.select("sid", "_g", F.struct("ordinal", "name", "sid").alias("_o")), "sid")
    pts = rows.groupBy("_g", "ts").agg(consolidate(func, "_o" if ordered else "ts").alias("value"), F.count("value").alias("n"))
    if xff or (xff is None and s.hinted):
        # without a factor of its own, the largest that a member of the group was given
        need = F.lit(xff) if xff else F.col("factor")
        pts = pts.join(out.select("_g", "members", "factor"), "_g").where(F.col("n") >= need * F.col("members"))
    name = F.lit(name) if isinstance(name, str) else name
    return Series(shaped(out.where("members > 0").withColumn("name", name)), pts.select(F.xxhash64("_g").alias("sid"), "ts", "value"))
