"""The functions of the query language.

Each is registered under its names and gets (context, call, *arguments): series sets
and constants, or syntax trees where it evaluates them itself (``lazy``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import smoothing, timeparse
from tidemark.plans.frame import DIM_COLUMNS, Series, by_time, canonical, combine, consolidate, factor, shaped, union
from tidemark.plans.language import Call, Const, QueryError, Ref

REGISTRY: dict[str, tuple[Callable, bool]] = {}


def register(*names: str, lazy: bool = False):
    def add(f):
        for n in names:
            REGISTRY[n] = (f, lazy)
        return f

    return add


def _text(v) -> str:
    return f"{v:g}" if isinstance(v, float) else str(v)


def _named(s: Series, fn: str, *args) -> Series:
    """Name each series fn(name,args...)."""
    tail = "".join(f",{_text(a)}" if not isinstance(a, str) else f",'{a}'" for a in args)
    return s.renamed(F.concat(F.lit(f"{fn}("), F.col("name"), F.lit(f"{tail})")))


def _nodes() -> Column:
    return F.split("name", r"\.")


def _node(k) -> Column:
    """Node k of the name (negative: from the end), or the tag of that name."""
    if isinstance(k, str):
        return F.coalesce(F.element_at("tags", F.lit(k)), F.lit(""))
    return F.coalesce(F.get(_nodes(), F.lit(k) if k >= 0 else F.size(_nodes()) + k), F.lit(""))


def _key(nodes) -> Column:
    return F.concat_ws(".", *map(_node, nodes))


def _option(s: Series, **kv) -> Series:
    new = F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k, _text(v))))
    return s.with_dim(options=F.map_concat(F.map_filter("options", lambda k, _: ~k.isin(list(kv))), new))


def _java(replacement: str) -> str:
    """\\1 becomes $1; a literal dollar is kept."""
    return re.sub(r"\\(\d+)", r"$\1", replacement.replace("$", r"\$"))


def _series(*args) -> Series:
    bad = [a for a in args if not isinstance(a, Series)]
    if bad:
        raise QueryError(f"a series is needed, not {bad[0]!r}")
    return union(list(args))


# alias group


@register("alias")
def alias(ctx, call, s, name):
    return s.renamed(F.lit(name))


@register("aliasByMetric")
def alias_by_metric(ctx, call, s):
    return s.renamed(F.element_at(_nodes(), -1))


@register("aliasByNode", "aliasByTags")
def alias_by_node(ctx, call, s, *nodes):
    return s.renamed(_key(nodes))


@register("aliasSub")
def alias_sub(ctx, call, s, search, replace):
    return s.renamed(F.regexp_replace("name", search, _java(replace)))


@register("aliasQuery")
def alias_query(ctx, call, s, search, replace, name):
    """Names from the last value of the series found under the rewritten name."""
    wanted = s.dim.select(F.regexp_replace("name", search, _java(replace)).alias("key")).distinct()
    other = ctx.read_where(lambda c: c.join(wanted, "key", "left_semi"))
    last = other.stats("last").select(F.col("name").alias("_key"), F.col("stat").alias("_v"))
    dim = s.dim.withColumn("_key", F.regexp_replace("name", search, _java(replace))).join(last, "_key", "left")
    shown = F.format_string(name, F.col("_v").cast("bigint") if "%d" in name else F.col("_v"))
    return Series(dim.withColumn("name", F.when(F.col("_v").isNotNull(), shown).otherwise(F.col("name"))).drop("_key", "_v").select(*s.dim.columns), s.pts)


def _unit(v: Column, system: str | None) -> Column:
    """A value with a unit letter for thousands (si) or powers of 1024 (binary)."""
    if system not in ("si", "binary"):
        return F.format_string("%.2f", v)
    base, out = (1000.0 if system == "si" else 1024.0), F.format_string("%.2f", v)
    for k, u in enumerate("KMGTPE", 1):
        unit = u if system == "si" else f"{u}i"
        out = F.when(F.abs(v) >= base**k, F.format_string(f"%.2f%s", v / base**k, F.lit(unit))).otherwise(out)
    return out


@register("legendValue")
def legend_value(ctx, call, s, *kinds):
    system = next((k for k in kinds if k in ("si", "binary")), None)
    funcs = [k for k in kinds if k not in ("si", "binary")]
    stats = s.pts.groupBy("sid").agg(*(consolidate(f).alias(f"_{i}") for i, f in enumerate(funcs)))
    dim = s.dim.join(stats, "sid", "left")
    tail = [F.concat(F.lit(f" ({f}: "), F.coalesce(_unit(F.col(f"_{i}"), system), F.lit("None")), F.lit(")")) for i, f in enumerate(funcs)]
    return Series(dim.withColumn("name", F.concat("name", *tail)).select(*s.dim.columns), s.pts)


@register("cactiStyle")
def cacti_style(ctx, call, s, system=None, units=None):
    stats = s.pts.groupBy("sid").agg(consolidate("last").alias("_l"), F.max("value").alias("_x"), F.min("value").alias("_n"))
    show = lambda c: F.concat(F.coalesce(_unit(F.col(c), system), F.lit("nan")), F.lit(f" {units}" if units else ""))
    dim = s.dim.join(stats, "sid", "left")
    name = F.concat("name", F.lit(" Current:"), show("_l"), F.lit(" Max:"), show("_x"), F.lit(" Min:"), show("_n"))
    return Series(dim.withColumn("name", name).select(*s.dim.columns), s.pts)


@register("substr")
def substr(ctx, call, s, start=0, stop=0):
    n = _nodes()
    lo = F.lit(start) if start >= 0 else F.greatest(F.size(n) + start, F.lit(0))
    hi = F.size(n) if stop == 0 else (F.lit(stop) if stop > 0 else F.size(n) + stop)
    return s.renamed(F.concat_ws(".", F.slice(n, lo + 1, F.greatest(hi - lo, F.lit(0)))))


# combine group


def _combined(func: str, shown: str):
    def f(ctx, call, *args):
        text = f"{shown}({','.join(a.text for a in call.args)})"
        s = _series(*args)
        return combine(s, func, text)

    return f


#: Registered name to (function, shown name) of those that combine all series at each time.
COMBINERS: dict[str, tuple[str, str]] = {}

for _names, _func, _shown in (
    (("sum", "sumSeries"), "sum", "sumSeries"),
    (("avg", "avgSeries", "averageSeries"), "average", "averageSeries"),
    (("maxSeries",), "max", "maxSeries"),
    (("minSeries",), "min", "minSeries"),
    (("multiplySeries",), "multiply", "multiplySeries"),
    (("rangeOfSeries",), "range", "rangeOfSeries"),
    (("stddevSeries",), "stddev", "stddevSeries"),
    (("diffSeries",), "diff", "diffSeries"),
):
    register(*_names)(_combined(_func, _shown))
    COMBINERS |= {n: (_func, _shown) for n in _names}


@register("aggregate")
def aggregate(ctx, call, s, func, x_files_factor=None):
    return combine(s, func, f"{canonical(func)}Series({call.args[0].text})", xff=x_files_factor)


def _with_wildcards(s: Series, func: str, positions) -> Series:
    kept = F.concat_ws(".", F.filter(_nodes(), lambda x, i: ~i.isin([int(p) for p in positions])))
    return combine(s, func, F.col("_g"), by=kept)


@register("aggregateWithWildcards")
def aggregate_with_wildcards(ctx, call, s, func, *positions):
    return _with_wildcards(s, func, positions)


for _name, _func in (("averageSeriesWithWildcards", "average"), ("sumSeriesWithWildcards", "sum"), ("multiplySeriesWithWildcards", "multiply")):
    register(_name)(lambda ctx, call, s, *positions, _func=_func: _with_wildcards(s, _func, positions))


@register("groupByNode")
def group_by_node(ctx, call, s, node, callback="average"):
    return combine(s, callback, F.col("_g"), by=_node(node))


@register("groupByNodes", "groupByTags")
def group_by_nodes(ctx, call, s, callback, *nodes):
    return combine(s, callback, F.col("_g"), by=_key(nodes))


@register("countSeries")
def count_series(ctx, call, *args):
    """The number of series at every step of the merged range."""
    s = combine(_series(*args), "count", f"countSeries({','.join(a.text for a in call.args)})")
    members = _series(*args).dim.agg(F.count("*").cast("double").alias("value"))
    grid = s.dim.where("step > 0 AND end_time > start_time").select("sid", F.explode(F.sequence("start_time", F.col("end_time") - F.col("step"), F.col("step"))).alias("ts"))
    return Series(s.dim, grid.join(F.broadcast(members)).select("sid", "ts", "value"))


@register("group")
def group(ctx, call, *args):
    return _series(*args)


@register("map", "mapSeries")
def map_series(ctx, call, s, *nodes):
    return s.with_dim(group_key=F.concat_ws(".", F.slice(_nodes(), 1, int(nodes[0]) + 1)) if len(nodes) == 1 and isinstance(nodes[0], int) else _key(nodes))


@register("reduce", "reduceSeries")
def reduce_series(ctx, call, s, function, node, *matchers):
    """Call ``function`` once a group, its series as arguments in the order of the matchers.

    Functions that combine all series, divisions and percentages are one plan for all
    groups.  For any other function the groups' keys are gathered on the driver, and their
    number is bounded by what a plan can hold.
    """
    f, lazy = _function(function)
    if lazy:
        raise QueryError(f"{function} cannot reduce")
    match = _node(node)
    dim = s.dim.withColumn("_m", match).where(F.col("_m").isin(list(matchers)))
    prefix = F.coalesce("group_key", F.concat_ws(".", F.slice(_nodes(), 1, int(node))))
    dim = dim.withColumn("_p", prefix)
    label = F.concat("_p", F.lit(f".reduce.{function}"))
    if function in COMBINERS:
        place = F.array_position(F.array(*map(F.lit, matchers)), F.col("_m")) - 1
        own = dim.withColumn("ordinal", F.col("ordinal") + place * F.lit(1 << 40)).withColumn("group_key", F.col("_p"))
        own = Series(own.select(*DIM_COLUMNS), s.pts.join(own.select("sid"), "sid", "left_semi"), s.hinted)
        return combine(own, COMBINERS[function][0], F.concat("_g", F.lit(f".reduce.{function}")), by=F.col("group_key"))
    if function in ("divideSeries", "asPercent", "pct") and len(matchers) == 2 and matchers[0] != matchers[1]:
        left, right = (dim.where(F.col("_m") == m) for m in matchers)
        by = s.pts.join(right.select("sid", "_p"), "sid").groupBy("_p", "ts").agg(F.first("value", True).alias("_d"))
        rows = s.pts.join(left.select("sid", "_p"), "sid").join(by, ["_p", "ts"], "left")
        v = F.try_divide("value", "_d") * (1 if function == "divideSeries" else 100)
        return Series(left.withColumn("name", label).select(*DIM_COLUMNS), rows.select("sid", "ts", v.alias("value")), s.hinted)
    keys = sorted(r[0] for r in dim.select("_p").distinct().collect())
    parts = []
    for k, key in enumerate(keys):
        own = []
        for m in matchers:
            d = dim.where((F.col("_p") == key) & (F.col("_m") == m)).drop("_m", "_p")
            own.append(Series(d, s.pts.join(d.select("sid"), "sid", "left_semi")))
        done = f(ctx, Call(function, tuple(Ref(f"{key}.{m}") for m in matchers)), *own)
        parts.append(done.renamed(F.lit(f"{key}.reduce.{function}")))
    return union(parts) if parts else Series(s.dim.limit(0), s.pts.limit(0))


@register("isNonNull")
def is_non_null(ctx, call, s):
    d = s.dense().select("sid", "ts", F.col("value").isNotNull().cast("double").alias("value"))
    return _named(Series(s.dim, d), "isNonNull")


@register("percentileOfSeries")
def percentile_of_series(ctx, call, s, n, interpolate=False):
    if n <= 0:
        raise QueryError("the percentile must be above 0")
    name = f"percentileOfSeries({call.args[0].text},{_text(n)})"
    base = combine(s, "count", name)
    q = F.percentile("value", F.lit(n / 100)) if interpolate else F.expr(f"percentile_disc({n / 100}) WITHIN GROUP (ORDER BY value)")
    return Series(base.dim, s.pts.groupBy("ts").agg(q.alias("value")).select(F.xxhash64(F.lit("")).alias("sid"), "ts", "value"))


@register("powSeries")
def pow_series(ctx, call, *args):
    s = _series(*args)
    base = combine(s, "count", f"powSeries({','.join(a.text for a in call.args)})")
    rows = s.joined("ordinal").where("value IS NOT NULL").groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("a"))
    rest = F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))
    v = F.aggregate(rest, F.get("a", F.lit(0))["value"], lambda acc, x: F.pow(acc, x["value"]))
    return Series(base.dim, rows.select(F.xxhash64(F.lit("")).alias("sid"), "ts", v.alias("value")))


def _by_one(s: Series, one: Series, op, fn: str, shown: str) -> Series:
    d = one.pts.groupBy("ts").agg(F.first("value", True).alias("_d"))
    pts = s.pts.join(d, "ts", "left").select("sid", "ts", op(F.col("value"), F.col("_d")).alias("value"))
    return Series(s.dim.withColumn("name", F.concat(F.lit(f"{fn}("), F.col("name"), F.lit(f",{shown})"))), pts)


@register("divideSeries")
def divide_series(ctx, call, s, divisor):
    return _by_one(s, divisor, F.try_divide, "divideSeries", call.args[1].text)


def _ranked(s: Series) -> Series:
    """Series numbered 1, 2, ... by ordinal, then name (a window over the dimension only)."""
    return Series(s.dim.withColumn("_k", F.row_number().over(Window.orderBy("ordinal", "name", "sid"))), s.pts)


@register("divideSeriesLists")
def divide_series_lists(ctx, call, a, b):
    x, y = _ranked(a), _ranked(b)
    if a.dim.count() != b.dim.count():
        raise QueryError("dividend and divisor lists differ in length")
    left = x.joined("_k")
    right = y.joined("_k").select("_k", "ts", F.col("value").alias("_d"))
    names = y.dim.select("_k", F.col("name").alias("_n"))
    dim = x.dim.join(names, "_k").withColumn("name", F.concat(F.lit("divideSeries("), "name", F.lit(","), "_n", F.lit(")"))).select(*a.dim.columns)
    return Series(dim, left.join(right, ["_k", "ts"], "left").select("sid", "ts", F.try_divide("value", "_d").alias("value")))


@register("weightedAverage")
def weighted_average(ctx, call, a, w, *nodes):
    left = a.pts.join(a.dim.select("sid", _key(nodes).alias("_k")), "sid").select("_k", "ts", F.col("value").alias("_a"))
    right = w.pts.join(w.dim.select("sid", _key(nodes).alias("_k")), "sid").select("_k", "ts", F.col("value").alias("_w"))
    name = f"weightedAverage({','.join(x.text for x in call.args)})"
    both = left.join(right, ["_k", "ts"]).where("_a IS NOT NULL AND _w IS NOT NULL")
    pts = both.groupBy("ts").agg(F.try_divide(F.sum(F.col("_a") * F.col("_w")), F.sum("_w")).alias("value"))
    return Series(combine(a, "count", name).dim, pts.select(F.xxhash64(F.lit("")).alias("sid"), "ts", "value"))


@register("asPercent", "pct")
def as_percent(ctx, call, s, total=None, *nodes):
    """100 * value / total: of all series, of a number, of one series, of as many series, or of the node group."""
    v, shown = F.col("value"), call.args[1].text if len(call.args) > 1 else None
    if isinstance(total, (int, float)):
        return _named(s.with_value(100 * v / F.lit(float(total))), "asPercent", total)
    if nodes:
        keyed = s.dim.withColumn("_k", _key(nodes))
        t = s if total is None else total
        tk = t.dim.withColumn("_k", _key(nodes))
        sums = t.pts.join(tk.select("sid", "_k"), "sid").groupBy("_k", "ts").agg(F.sum("value").alias("_t"))
        names = tk.groupBy("_k").agg(F.min("name").alias("_n"), F.count("*").alias("_c"), *(F.min(c).alias(f"_{c}") for c in ("ordinal", "start_time", "end_time", "step")))
        if total is None:
            label = F.concat(F.lit("asPercent("), "name", F.lit(",None)"))
            dim = keyed.withColumn("name", label).drop("_k")
        else:
            of = F.when(F.col("_c") > 1, F.concat(F.lit("sumSeries("), "_k", F.lit(")"))).otherwise(F.coalesce("_n", F.lit("MISSING")))
            full = keyed.join(names, "_k", "full_outer")
            dim = full.withColumn("name", F.concat(F.lit("asPercent("), F.coalesce("name", F.lit("MISSING")), F.lit(","), of, F.lit(")")))
            dim = dim.withColumn("sid", F.coalesce("sid", F.xxhash64("_k", F.lit("missing"))))
            for c in ("ordinal", "start_time", "end_time", "step"):
                dim = dim.withColumn(c, F.coalesce(c, F.col(f"_{c}")))
            empty = F.expr("cast(map() as map<string,string>)")
            dim = dim.withColumns({"options": F.coalesce("options", empty), "tags": F.coalesce("tags", empty)})
        pts = s.pts.join(keyed.select("sid", "_k"), "sid").join(sums, ["_k", "ts"], "left")
        return Series(dim.select(*s.dim.columns), pts.select("sid", "ts", (100 * F.try_divide(v, "_t")).alias("value")))
    if total is None:
        t = s.pts.groupBy("ts").agg(F.sum("value").alias("_t"))
        pts = s.pts.join(t, "ts").select("sid", "ts", (100 * F.try_divide(v, "_t")).alias("value"))
        return _named(Series(s.dim, pts), "asPercent", *([] if shown is None else [None]))
    n = total.dim.limit(2).count()
    if n == 1:
        return _by_one(s, total, lambda a, b: 100 * F.try_divide(a, b), "asPercent", shown)
    out = divide_series_lists(ctx, call, s, total).with_value(100 * v)
    return out.renamed(F.regexp_replace("name", r"^divideSeries\(", "asPercent("))


# calculate group


@register("aggregateLine")
def aggregate_line(ctx, call, s, func="average"):
    stat = s.pts.groupBy("sid").agg(consolidate(func).alias("stat"))
    d = s.dense().drop("value").join(stat, "sid").select("sid", "ts", F.col("stat").alias("value"))
    return _named(Series(s.dim, d), "aggregateLine", func)


@register("nPercentile")
def n_percentile(ctx, call, s, n):
    stat = s.pts.groupBy("sid").agg(F.percentile("value", F.lit(n / 100)).alias("stat"))
    d = s.dense().drop("value").join(stat, "sid").select("sid", "ts", F.col("stat").alias("value"))
    return _named(Series(s.dim, d), "nPercentile", n)


def _moving(ctx, call, s, size, func, xff, fn):
    """Over the N points (or the time) before each point; the point itself is not part of it."""
    if isinstance(size, str):
        seconds = abs(timeparse.duration(size))
        w, need = Window.partitionBy("sid").orderBy("ts").rangeBetween(-seconds, -1), F.lit(float(seconds)) / F.col("step")
    else:
        w, need = Window.partitionBy("sid").orderBy("i").rangeBetween(-int(size), -1), F.lit(float(size))
    known = F.count("value").over(w)
    if xff is None and s.hinted:
        s = Series(s.dim.withColumn("_f", factor()), s.pts)
        xff, share = 1.0, F.col("_f")
    else:
        share = F.lit(float(xff or 0))
    func = canonical(func)
    match func:
        case "range":
            v = F.max("value").over(w) - F.min("value").over(w)
        case "diff":
            v = 2 * F.first("value", True).over(w) - F.sum("value").over(w)
        case "last":
            v = F.last("value", True).over(w)
        case "first":
            v = F.first("value", True).over(w)
        case _:
            v = consolidate(func).over(w)
    ok = known > 0 if not xff else (known > 0) & (known >= share * need)
    d = s.dense(*(["_f"] if "_f" in s.dim.columns else [])).select("sid", "ts", F.when(ok, v).alias("value"))
    return _named(Series(s.dim.select(*DIM_COLUMNS), d), fn, size)


@register("movingWindow")
def moving_window(ctx, call, s, size, func="average", xff=None):
    return _moving(ctx, call, s, size, func, xff, f"moving{canonical(func).capitalize()}")


for _name, _func in (("movingAverage", "average"), ("movingMax", "max"), ("movingMedian", "median"), ("movingMin", "min"), ("movingSum", "sum")):
    register(_name)(lambda ctx, call, s, size, xff=None, _f=_func, _n=_name: _moving(ctx, call, s, size, _f, xff, _n))


@register("stdev")
def stdev(ctx, call, s, points, tolerance=0.1):
    w = Window.partitionBy("sid").orderBy("i").rowsBetween(-(int(points) - 1), 0)
    known, seen = F.count("value").over(w), F.count(F.lit(1)).over(w)
    v = F.when((known > 0) & ((seen - known) / F.lit(float(points)) <= tolerance), F.stddev_pop("value").over(w))
    return _named(Series(s.dim, s.dense().select("sid", "ts", v.alias("value"))), "stdev", points)


@register("linearRegression", lazy=True)
def linear_regression(ctx, call, node, start=None, end=None):
    """A line fitted to each series, on a source window of its own if given."""
    s = ctx.evaluate(node)
    lo, hi = (timeparse.relative_time(ctx.value(x), ctx.now) if x is not None and ctx.value(x) is not None else None for x in (start, end))
    src = s if lo is None and hi is None else ctx.between(lo if lo is not None else ctx.start, hi if hi is not None else ctx.end).evaluate(node)
    # centred on the query's start, so that epoch seconds do not cost digits
    x = (F.col("ts") - F.lit(ctx.start)).cast("double")
    fit = src.joined("name").where("value IS NOT NULL").groupBy("name").agg(F.regr_slope("value", x).alias("_b"), F.regr_intercept("value", x).alias("_a"))
    d = s.dense("name").drop("value").join(fit, "name").select("sid", "ts", (F.col("_a") + F.col("_b") * x).alias("value"))
    return _named(Series(s.dim, d), "linearRegression")


@register("exponentialMovingAverage")
def exponential_moving_average(ctx, call, s, size):
    return _named(Series(s.dim, smoothing.exponential(s.dense("name"), size)), "exponentialMovingAverage", size)


def _holt_winters(ctx, node, bootstrap, seasonality):
    """Forecast and deviation on a range extended back by the bootstrap interval, cut to the query's range again."""
    long = ctx.between(ctx.start - timeparse.duration(bootstrap), ctx.end).evaluate(node)
    s = ctx.evaluate(node)
    rows = smoothing.holt_winters(long.dense("name"), timeparse.duration(seasonality))
    rows = rows.join(s.dim.select(F.col("sid").alias("_sid"), F.col("start_time").alias("_lo")), F.col("sid") == F.col("_sid")).where("ts >= _lo").drop("_sid", "_lo")
    return s, rows


@register("holtWintersForecast", lazy=True)
def holt_winters_forecast(ctx, call, node, bootstrap=Const("7d", ""), seasonality=Const("1d", "")):
    s, rows = _holt_winters(ctx, node, bootstrap.value, seasonality.value)
    return _named(Series(s.dim, rows.select("sid", "ts", F.col("forecast").alias("value"))), "holtWintersForecast")


def _bands(ctx, node, delta, bootstrap, seasonality):
    s, rows = _holt_winters(ctx, node, bootstrap.value, seasonality.value)
    d = float(delta.value)
    upper = _named(Series(s.dim, rows.select("sid", "ts", (F.col("forecast") + d * F.col("deviation")).alias("value"))), "holtWintersConfidenceUpper")
    lower = _named(Series(s.dim, rows.select("sid", "ts", (F.col("forecast") - d * F.col("deviation")).alias("value"))), "holtWintersConfidenceLower")
    return s, rows, union([lower, upper])


@register("holtWintersConfidenceBands", lazy=True)
def holt_winters_bands(ctx, call, node, delta=Const(3, ""), bootstrap=Const("7d", ""), seasonality=Const("1d", "")):
    return _bands(ctx, node, delta, bootstrap, seasonality)[2]


@register("holtWintersConfidenceArea", lazy=True)
def holt_winters_area(ctx, call, node, delta=Const(3, ""), bootstrap=Const("7d", ""), seasonality=Const("1d", "")):
    return _option(_bands(ctx, node, delta, bootstrap, seasonality)[2], areaBetween="true")


@register("holtWintersAberration", lazy=True)
def holt_winters_aberration(ctx, call, node, delta=Const(3, ""), bootstrap=Const("7d", ""), seasonality=Const("1d", "")):
    s, rows, _ = _bands(ctx, node, delta, bootstrap, seasonality)
    d, v = float(delta.value), F.col("value")
    up, low = F.col("forecast") + d * F.col("deviation"), F.col("forecast") - d * F.col("deviation")
    out = F.when(v > up, v - up).when(v < low, v - low).when(v.isNotNull(), 0.0)
    return _named(Series(s.dim, rows.select("sid", "ts", out.alias("value"))), "holtWintersAberration")


# filter points group


def _kept_if(fn: str, keep):
    def f(ctx, call, s, n):
        return _named(s.with_value(F.when(keep(F.col("value"), float(n)), F.col("value"))), fn, n)

    return f


register("removeAboveValue")(_kept_if("removeAboveValue", lambda v, n: v <= n))
register("removeBelowValue")(_kept_if("removeBelowValue", lambda v, n: v >= n))


def _percentile_cut(fn: str, keep):
    def f(ctx, call, s, n):
        p = s.pts.groupBy("sid").agg(F.percentile("value", F.lit(n / 100)).alias("_p"))
        v = F.col("value")
        return _named(Series(s.dim, s.pts.join(p, "sid").select("sid", "ts", F.when(keep(v, F.col("_p")), v).alias("value"))), fn, n)

    return f


register("removeAbovePercentile")(_percentile_cut("removeAbovePercentile", lambda v, p: v <= p))
register("removeBelowPercentile")(_percentile_cut("removeBelowPercentile", lambda v, p: v >= p))

# filter series group

OPERATORS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _filtered(s: Series, func: str, op: str, n: float) -> Series:
    if op not in OPERATORS:
        raise QueryError(f"unknown operator {op!r}")
    stat, n = F.col("stat"), F.lit(float(n))
    # the last bits of a sum depend on the order of adding: what differs from n by no more than that is n
    near = F.abs(stat - n) < F.lit(1e-12) * F.greatest(F.abs(stat), F.abs(n))
    return s.only(s.stats(func).where(OPERATORS[op](F.when(near, n).otherwise(stat), n)))


@register("filterSeries")
def filter_series(ctx, call, s, func, op, n):
    return _filtered(s, func, op, n)


for _name, _func, _op in (
    ("averageAbove", "average", ">"), ("averageBelow", "average", "<"), ("currentAbove", "last", ">"), ("currentBelow", "last", "<"),
    ("maximumAbove", "max", ">"), ("maximumBelow", "max", "<"), ("minimumAbove", "min", ">"), ("minimumBelow", "min", "<"),
):
    register(_name)(lambda ctx, call, s, n, _f=_func, _o=_op: _filtered(s, _f, _o, n))


def _top(s: Series, n: int, func: str, highest: bool) -> Series:
    """The n highest or lowest; equal ones by ordinal, then name.  A top-k, not a sort of all series."""
    by = F.desc_nulls_last("stat") if highest else F.asc_nulls_last("stat")
    top = s.stats(func).where("stat IS NOT NULL").orderBy(by, "ordinal", "name").limit(int(n))
    ranked = top.select("sid", F.row_number().over(Window.orderBy(by, "ordinal", "name")).cast("bigint").alias("_o"))
    dim = s.dim.join(ranked, "sid").withColumn("ordinal", F.col("_o")).select(*s.dim.columns)
    return Series(dim, s.pts.join(ranked.select("sid"), "sid", "left_semi"))


@register("highest")
def highest(ctx, call, s, n=1, func="average"):
    return _top(s, n, func, True)


@register("lowest")
def lowest(ctx, call, s, n=1, func="average"):
    return _top(s, n, func, False)


for _name, _func, _high in (
    ("highestAverage", "average", True), ("highestCurrent", "last", True), ("highestMax", "max", True),
    ("lowestAverage", "average", False), ("lowestCurrent", "last", False), ("mostDeviant", "stddev", True),
):
    register(_name)(lambda ctx, call, s, n, _f=_func, _h=_high: _top(s, n, _f, _h))


@register("limit")
def limit(ctx, call, s, n):
    return s.only(s.dim.orderBy("ordinal", "name").limit(int(n)))


@register("grep")
def grep(ctx, call, s, pattern):
    return s.only(s.dim.where(F.col("name").rlike(pattern)))


@register("exclude")
def exclude(ctx, call, s, pattern):
    return s.only(s.dim.where(~F.col("name").rlike(pattern)))


@register("averageOutsidePercentile")
def average_outside_percentile(ctx, call, s, n):
    n = max(n, 100 - n)
    stat = s.stats("average")
    band = stat.agg(F.percentile("stat", F.lit((100 - n) / 100)).alias("_lo"), F.percentile("stat", F.lit(n / 100)).alias("_hi"))
    return s.only(stat.join(F.broadcast(band)).where("stat <= _lo OR stat >= _hi"))


@register("removeBetweenPercentile")
def remove_between_percentile(ctx, call, s, n):
    n = max(n, 100 - n)
    band = s.pts.groupBy("ts").agg(F.percentile("value", F.lit((100 - n) / 100)).alias("_lo"), F.percentile("value", F.lit(n / 100)).alias("_hi"))
    return s.only(s.pts.join(band, "ts").where("value < _lo OR value > _hi").select("sid").distinct())


@register("removeEmptySeries")
def remove_empty_series(ctx, call, s, xff=None):
    n = s.pts.groupBy("sid").agg(F.count("value").alias("_n"))
    d = s.dim.join(n, "sid")
    slots = (F.col("end_time") - F.col("start_time")) / F.col("step")
    return s.only(d.where((F.col("_n") > 0) & (F.col("_n") >= F.lit(float(xff or 0)) * slots)))


@register("unique")
def unique(ctx, call, *args):
    s = _series(*args)
    first = s.dim.groupBy("name").agg(F.min(F.struct("ordinal", "sid")).alias("m")).select(F.col("m.sid").alias("sid"))
    return s.only(first)


@register("useSeriesAbove")
def use_series_above(ctx, call, s, value, search, replace):
    """The series found under the rewritten names of those whose maximum is above ``value``."""
    names = s.stats("max").where(F.col("stat") > float(value)).select(F.regexp_replace("name", search, _java(replace)).alias("name")).distinct()
    return ctx.read_where(lambda c: c.join(names.withColumnRenamed("name", "key"), "key", "left_semi"))


# graph group: hints for whoever draws


for _name in ("areaBetween", "secondYAxis"):
    register(_name)(lambda ctx, call, s, _n=_name: _option(s, **{_n: "true"}))
for _name in ("alpha", "color", "lineWidth"):
    register(_name)(lambda ctx, call, s, v, _n=_name: _option(s, **{_n: v}))


@register("dashed")
def dashed(ctx, call, s, length=5):
    return _option(_named(s, "dashed", length), dashed=length)


@register("drawAsInfinite")
def draw_as_infinite(ctx, call, s):
    return _option(_named(s, "drawAsInfinite"), drawAsInfinite="true")


@register("stacked")
def stacked(ctx, call, s, name="__DEFAULT__"):
    w = Window.partitionBy("ts").orderBy("ordinal", "name", "sid").rowsBetween(Window.unboundedPreceding, 0)
    pts = s.joined("ordinal", "name").where("value IS NOT NULL").select("sid", "ts", F.sum("value").over(w).alias("value"))
    return _option(_named(Series(s.dim, pts), "stacked"), stacked=name)


def _line(ctx, name: str, value: float, ts: list[int] | None = None) -> Series:
    spark = ctx.spark
    step = max(1, ctx.default_step)
    dim = shaped(spark.range(1).select(F.xxhash64(F.lit(name)).alias("sid"), F.lit(name).alias("name"), F.lit(ctx.start).cast("bigint").alias("start_time"), F.lit(ctx.end).cast("bigint").alias("end_time"), F.lit(step).cast("bigint").alias("step")))
    at = F.explode(F.array(*(F.lit(t).cast("bigint") for t in ts))) if ts is not None else F.explode(F.sequence("start_time", F.col("end_time") - step, F.lit(step).cast("bigint")))
    return Series(dim, dim.select("sid", at.alias("ts")).withColumn("value", F.lit(float(value))))


@register("constantLine")
def constant_line(ctx, call, value):
    return _line(ctx, _text(value), value)


@register("threshold")
def threshold(ctx, call, value, label=None, color=None):
    s = _line(ctx, label or _text(value), value)
    return _option(s, color=color) if color else s


@register("verticalLine")
def vertical_line(ctx, call, ts, label=None, color=None):
    at = timeparse.relative_time(ts, ctx.now)
    if not ctx.start <= at <= ctx.end:
        raise QueryError("the line lies outside of the range")
    s = _option(_line(ctx, label or "verticalLine", 1.0, [at]), drawAsInfinite="true")
    return _option(s, color=color) if color else s


@register("identity")
def identity(ctx, call, name):
    return _line(ctx, name, 0).with_value(F.col("ts").cast("double"))


# sorting group


def _sorted(s: Series, *by: Column) -> Series:
    """New ordinals by a global order of the dimension (one row a series)."""
    keyed = s.dim.select("sid", "ordinal", "name").join(s.pts.groupBy("sid").agg(consolidate("average").alias("average"), *(consolidate(f).alias(f) for f in ("max", "min", "sum"))), "sid", "left")
    o = keyed.select("sid", F.row_number().over(Window.orderBy(*by, "ordinal", "name")).cast("bigint").alias("_o"))
    return Series(s.dim.join(o, "sid").withColumn("ordinal", F.col("_o")).select(*s.dim.columns), s.pts)


@register("sortBy")
def sort_by(ctx, call, s, func="average", reverse=False):
    k = s.stats(func)
    o = k.select("sid", F.row_number().over(Window.orderBy(F.desc_nulls_last("stat") if reverse else F.asc_nulls_last("stat"), "ordinal", "name")).cast("bigint").alias("_o"))
    return Series(s.dim.join(o, "sid").withColumn("ordinal", F.col("_o")).select(*s.dim.columns), s.pts)


@register("sortByMaxima")
def sort_by_maxima(ctx, call, s):
    return _sorted(s, F.desc_nulls_last("max"))


@register("sortByMinima")
def sort_by_minima(ctx, call, s):
    return _sorted(_filtered(s, "max", ">", 0), F.asc_nulls_last("min"))


@register("sortByTotal")
def sort_by_total(ctx, call, s):
    return _sorted(s, F.desc_nulls_last("sum"))


@register("sortByName")
def sort_by_name(ctx, call, s, natural=False, reverse=False):
    k = F.col("name")
    if natural:  # digit runs padded to 20 places
        k = F.regexp_replace(F.regexp_replace("name", r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return _sorted(s, F.desc(k) if reverse else F.asc(k))


# special group


@register("changed")
def changed(ctx, call, s):
    before = F.last("value", True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    v = F.coalesce(F.col("value") != before, F.lit(False)).cast("double")
    return _named(Series(s.dim, s.dense().select("sid", "ts", v.alias("value"))), "changed")


@register("consolidateBy")
def consolidate_by(ctx, call, s, func):
    return _option(s, consolidateBy=canonical(func))


@register("cumulative")
def cumulative(ctx, call, s):
    return _option(s, consolidateBy="sum")


@register("setXFilesFactor", "xFilesFactor")
def set_xff(ctx, call, s, x):
    return _option(s, xFilesFactor=float(x))


@register("events")
def events(ctx, call, *tags):
    """Events with all of the tags ('*': any) counted in each step."""
    step = max(1, ctx.default_step)
    e = ctx.store.events
    if e is None:
        raise QueryError("the store has no events")
    e = e.where((F.col("ts") >= ctx.start) & (F.col("ts") < ctx.end))
    for t in tags:
        if t != "*":
            e = e.where(F.array_contains("tags", t))
    line = _line(ctx, f"events({','.join(tags)})", 0.0)
    n = e.groupBy((F.lit(ctx.start) + F.floor((F.col("ts") - ctx.start) / step) * step).alias("ts")).agg(F.count("*").cast("double").alias("value"))
    return Series(line.dim, line.pts.drop("value").join(n, "ts").select("sid", "ts", "value"))


@register("fallbackSeries", lazy=True)
def fallback_series(ctx, call, node, fallback):
    s = ctx.evaluate(node)
    return s if s.dim.limit(1).count() else ctx.evaluate(fallback)


@register("seriesByTag")
def series_by_tag(ctx, call, *expressions):
    """Series whose tags meet all of tag=v, tag!=v, tag=~re, tag!=~re; an absent tag is ''."""
    ok_all = F.lit(True)
    for e in expressions:
        m = re.fullmatch(r"([^!=~]+)(!=~|=~|!=|=)(.*)", e, re.S)
        if not m:
            raise QueryError(f"invalid tag expression {e!r}")
        tag, op, v = m.groups()
        ok_all = ok_all & _tag_test(tag, op, v)
    # the catalogue is filtered first; only the points of the series left are read
    return ctx.read_where(lambda c: (c if "tags" in c.columns else c.withColumn("tags", F.expr("cast(map() as map<string,string>)"))).where(ok_all))


def _tag_test(tag: str, op: str, v: str) -> Column:
    have = F.coalesce(F.element_at("tags", F.lit(tag)), F.col("key") if tag == "name" else F.lit(""))
    ok = have.rlike(f"^(?:{v})") if "~" in op else have == v
    return ~ok if op[0] == "!" else ok


# transform group


def _each(name: str, value):
    def f(ctx, call, s, *args):
        return _named(s.with_value(value(F.col("value"), *args)), name, *args)

    register(name)(f)


_each("absolute", lambda v: F.abs(v))
_each("invert", lambda v: F.try_divide(F.lit(1.0), v))
_each("squareRoot", lambda v: F.when(v >= 0, F.sqrt(v)))
_each("log", lambda v, base=10: F.when(v > 0, F.log(float(base), v)))
_each("pow", lambda v, k: F.pow(v, F.lit(float(k))))
_each("offset", lambda v, k: v + float(k))
_each("round", lambda v, digits=0: F.round(v, int(digits)))


@register("scale")
def scale(ctx, call, s, k):
    """Each series times a number, under its own name."""
    return s.with_value(F.col("value") * float(k))


@register("scaleToSeconds")
def scale_to_seconds(ctx, call, s, seconds):
    return _named(Series(s.dim, s.joined("step").select("sid", "ts", (F.col("value") * float(seconds) / F.col("step")).alias("value"))), "scaleToSeconds", seconds)


def _windowed(s: Series, value: Column, name: str, *args) -> Series:
    return _named(Series(s.dim, s.dense().select("sid", "ts", value.alias("value"))), name, *args)


@register("delay")
def delay(ctx, call, s, steps):
    return _windowed(s, F.lag("value", int(steps)).over(by_time()), "delay", steps)


@register("derivative")
def derivative(ctx, call, s):
    return _windowed(s, F.col("value") - F.lag("value").over(by_time()), "derivative")


def _non_negative(max_value) -> Column:
    v, before = F.col("value"), F.lag("value").over(by_time())
    d = v - before
    if max_value is None:
        return F.when(d >= 0, d)
    m = float(max_value)
    return F.when(v > m, None).when(d >= 0, d).when(d < 0, m - before + v + 1)


@register("nonNegativeDerivative")
def non_negative_derivative(ctx, call, s, max_value=None):
    return _windowed(s, _non_negative(max_value), "nonNegativeDerivative")


@register("perSecond")
def per_second(ctx, call, s, max_value=None):
    return _windowed(s, _non_negative(max_value) / F.col("step"), "perSecond")


@register("integral")
def integral(ctx, call, s):
    total = F.sum("value").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    pts = s.pts.select("sid", "ts", F.when(F.col("value").isNotNull(), total).alias("value"))
    return _named(Series(s.dim, pts), "integral")


@register("integralByInterval")
def integral_by_interval(ctx, call, s, unit):
    k = abs(timeparse.duration(unit))
    rows = s.joined("start_time").withColumn("_b", F.floor((F.col("ts") - F.col("start_time")) / k))
    total = F.sum("value").over(by_time("_b").rowsBetween(Window.unboundedPreceding, 0))
    return _named(Series(s.dim, rows.select("sid", "ts", F.when(F.col("value").isNotNull(), total).alias("value"))), "integralByInterval", unit)


def _neighbours(s: Series):
    """The dense grid with the places and values of the last known point before and the first after."""
    w = Window.partitionBy("sid").orderBy("i")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    return s.dense().select(
        "sid", "ts", "i", "value",
        F.last("value", True).over(back).alias("_v0"), F.last(at, True).over(back).alias("_i0"),
        F.first("value", True).over(ahead).alias("_v1"), F.first(at, True).over(ahead).alias("_i1"),
        F.max("i").over(Window.partitionBy("sid")).alias("_n"),
    )


@register("keepLastValue")
def keep_last_value(ctx, call, s, limit=float("inf")):
    gap = F.coalesce("_i1", F.col("_n") + 1) - F.col("_i0") - 1
    v = F.coalesce("value", F.when(gap <= F.lit(float(limit)), F.col("_v0")))
    return _named(Series(s.dim, _neighbours(s).select("sid", "ts", v.alias("value"))), "keepLastValue")


@register("interpolate")
def interpolate(ctx, call, s, limit=float("inf")):
    gap = F.col("_i1") - F.col("_i0") - 1
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    v = F.coalesce("value", F.when(gap <= F.lit(float(limit)), line))
    return _named(Series(s.dim, _neighbours(s).select("sid", "ts", v.alias("value"))), "interpolate")


@register("minMax")
def min_max(ctx, call, s):
    st = s.pts.groupBy("sid").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    v = F.when(F.col("_hi") == F.col("_lo"), F.when(F.col("value").isNotNull(), 0.0)).otherwise((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return _named(Series(s.dim, s.pts.join(st, "sid").select("sid", "ts", v.alias("value"))), "minMax")


@register("offsetToZero")
def offset_to_zero(ctx, call, s):
    st = s.pts.groupBy("sid").agg(F.min("value").alias("_lo"))
    return _named(Series(s.dim, s.pts.join(st, "sid").select("sid", "ts", (F.col("value") - F.col("_lo")).alias("value"))), "offsetToZero")


def _bucketed(s: Series, k: int, origin: Column, func: str) -> Series:
    """Consolidated values of buckets of k seconds that start at ``origin`` (a column over dim)."""
    start = (origin + F.floor((F.col("start_time") - origin) / k) * k).cast("bigint")
    dim = s.dim.withColumns({"_o": origin, "_s": start})
    at = (F.col("_o") + F.floor((F.col("t") - F.col("_o")) / k) * k).cast("bigint")
    rows = s.pts.withColumnRenamed("ts", "t").join(dim.select("sid", "_o"), "sid").select("sid", at.alias("b"), F.col("t").alias("ts"), "value")
    pts = rows.groupBy("sid", "b").agg(consolidate(func).alias("value")).select("sid", F.col("b").alias("ts"), "value")
    end = (F.col("_s") + F.ceil((F.col("end_time") - F.col("_s")) / k) * k).cast("bigint")
    dim = dim.withColumns({"end_time": end, "start_time": F.col("_s"), "step": F.lit(k).cast("bigint")})
    return Series(dim.select(*s.dim.columns), pts)


@register("summarize")
def summarize(ctx, call, s, interval, func="sum", align_to_from=False):
    k = abs(timeparse.duration(interval))
    return _named(_bucketed(s, k, F.col("start_time") if align_to_from else F.lit(0).cast("bigint"), func), "summarize", interval, func)


@register("smartSummarize")
def smart_summarize(ctx, call, s, interval, func="sum", align_to=None):
    """Buckets that start at the query's start, or at the start of its second, minute, hour, day, week, month or year."""
    k = abs(timeparse.duration(interval))
    start = F.col("start_time")
    if align_to is not None:
        start = F.unix_timestamp(F.date_trunc(align_to.rstrip("s0123456789") or align_to, F.timestamp_seconds(start)))
    return _named(_bucketed(s, k, start.cast("bigint"), func), "smartSummarize", interval, func)


@register("hitcount")
def hitcount(ctx, call, s, interval, align=False):
    """value * step summed in buckets; a sample across a border gives each side its seconds."""
    k = abs(timeparse.duration(interval))
    origin = F.lit(0).cast("bigint") if align else F.col("start_time")
    rows = s.pts.where("value IS NOT NULL").join(s.dim.select("sid", "step", origin.alias("_o")), "sid")
    lo, hi = F.floor((F.col("ts") - F.col("_o")) / k), F.floor((F.col("ts") + F.col("step") - 1 - F.col("_o")) / k)
    rows = rows.withColumn("_b", F.explode(F.sequence(lo, hi)))
    at = F.col("_o") + F.col("_b") * k
    seconds = F.least(F.col("ts") + F.col("step"), at + k) - F.greatest("ts", at)
    pts = rows.select("sid", at.cast("bigint").alias("b"), (F.col("value") * seconds).alias("value")).groupBy("sid", "b").agg(F.sum("value").alias("value")).select("sid", F.col("b").alias("ts"), "value")
    return _named(Series(_bucketed(s, k, origin, "sum").dim, pts), "hitcount", interval)


def _shifted(ctx, node, seconds: int, reset_end: bool = True) -> Series:
    s = ctx.between(ctx.start + seconds, ctx.end + seconds if reset_end else ctx.end).evaluate(node)
    dim = s.dim.withColumns({c: F.col(c) - seconds for c in ("start_time", "end_time")})
    return Series(dim, s.pts.select("sid", (F.col("ts") - seconds).alias("ts"), "value"))


def _back(text: str) -> int:
    """A shift: without a sign it goes back."""
    return timeparse.duration(text[1:]) if text.startswith("+") else -abs(timeparse.duration(text.lstrip("-")))


@register("timeShift", lazy=True)
def time_shift(ctx, call, node, shift, reset_end=None, align_dst=None):
    """Values from another time.  Without ``reset_end`` the shifted series goes on to what was read last; ``align_dst`` keeps the hour of the day across a change of daylight saving time."""
    t = ctx.value(shift)
    seconds = _back(t)
    if align_dst is not None and ctx.value(align_dst):
        seconds += _saving(ctx, ctx.start + seconds, ctx.end + seconds)
    keep = reset_end is None or ctx.value(reset_end) in (True, None)
    return _named(_shifted(ctx, node, seconds, keep), "timeShift", t)


def _saving(ctx, start: int, end: int) -> int:
    """Seconds by which a wholly shifted range differs in daylight saving time, in the session's time zone."""
    zone = ZoneInfo(ctx.spark.conf.get("spark.sql.session.timeZone"))
    extra = [datetime.fromtimestamp(t, zone).dst() or timedelta(0) for t in (ctx.start, ctx.end, start, end)]
    on = [bool(x) for x in extra]
    if on[:2] == [True, True] and on[2:] == [False, False]:
        return int(extra[0].total_seconds())
    return -int(extra[2].total_seconds()) if on == [False, False, True, True] else 0


@register("timeStack", lazy=True)
def time_stack(ctx, call, node, unit=Const("1d", ""), first=Const(0, ""), last=Const(7, "")):
    u = _back(ctx.value(unit))
    return union([_named(_shifted(ctx, node, u * k), "timeShift", ctx.value(unit), k) for k in range(int(first.value), int(last.value) + 1)])


@register("timeSlice")
def time_slice(ctx, call, s, start, end="now"):
    lo, hi = timeparse.relative_time(start, ctx.now), timeparse.relative_time(end, ctx.now)
    return _named(s.with_value(F.when(F.col("ts").between(lo, hi), F.col("value"))), "timeSlice", lo, hi)


@register("transformNull")
def transform_null(ctx, call, s, default=0, reference=None):
    d = s.dense()
    v = F.coalesce("value", F.lit(float(default)))
    if reference is not None:
        known = reference.pts.where("value IS NOT NULL").select("ts").distinct().withColumn("_r", F.lit(True))
        d = d.join(known, "ts", "left")
        v = F.coalesce("value", F.when(F.col("_r"), F.lit(float(default))))
    return _named(Series(s.dim, d.select("sid", "ts", v.alias("value"))), "transformNull", default)


@register("applyByNode", lazy=True)
def apply_by_node(ctx, call, node, number, template, new_name=None):
    """The template evaluated for each distinct prefix.

    A template that combines one pattern below the prefix, such as ``sumSeries(%.*)``, is one
    plan for all prefixes; any other takes a sub-plan a prefix, gathered on the driver.
    """
    from tidemark.plans.language import parse

    s = ctx.evaluate(node)
    n = int(ctx.value(number)) + 1
    prefix = F.concat_ws(".", F.slice(_nodes(), 1, n))
    m = re.fullmatch(r"(\w+)\(%(\.[^%(),\"']+)\)", ctx.value(template))
    if m and m[1] in COMBINERS and "**" not in m[2]:
        func, shown = COMBINERS[m[1]]
        wanted = s.dim.select(prefix.alias("_g")).distinct()
        below = ctx.read(".".join(["*"] * n) + m[2])
        own = below.dim.withColumn("_g", prefix).join(wanted, "_g", "left_semi").drop("_g")
        name = F.concat(F.lit(f"{shown}("), "_g", F.lit(f"{m[2]})"))
        if new_name is not None:
            name = F.replace(F.lit(ctx.value(new_name)), F.lit("%"), F.col("_g"))
        return combine(below.only(own), func, name, by=prefix)
    keys = sorted(r[0] for r in s.dim.select(prefix.alias("p")).distinct().collect())
    parts = []
    for k in keys:
        out = ctx.evaluate(parse(ctx.value(template).replace("%", k)))
        parts.append(out.renamed(F.lit(ctx.value(new_name).replace("%", k))) if new_name is not None else out)
    return union(parts) if parts else Series(s.dim.limit(0), s.pts.limit(0))


def _function(name: str) -> tuple[Callable, bool]:
    if name not in REGISTRY:
        raise QueryError(f"unknown function {name!r}")
    return REGISTRY[name]
