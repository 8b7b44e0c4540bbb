"""Registered time-series queries and the SQL that each must equal.

Series come from ``events`` under the keys events.<type>.u<user>; reads use a fixed now.
Computed doubles are rounded in both engines, since they add in different orders.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import glob
from tidemark.operators import catalog as cat
from tidemark.operators import buffer, ingest, read, stores
from tidemark.plans.evaluate import evaluate
from tidemark.plans.frame import consolidated
from tidemark.sources import lines, pickled, ringfile
from tidemark.sources import render as sinks

START, NOW, HOUR = 1704067200, 1706659200, 3600
#: Archives, factor and method of the engine's own tables in these queries.
TIERS = "60:31d,3600:90d,86400:365d"

E = "events.*.*"
T = 'groupByNode(events.*.*,1,"sum")'


def rounded(c: Column | str) -> Column:
    """Six places; the small shift keeps exact halves from falling apart between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ts (seconds), value, arrival of every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("events."), "event_type", F.lit(".u"), F.col("user_id").cast("string"))
    return e.select(key.alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "value", F.col("event_id").alias("arrival"))


def event_catalog(keys: DataFrame, archives: str = TIERS, method: int = 2, xff: float = 0.0) -> DataFrame:
    return keys.select("key").distinct().select("key", ingest.archives_column(archives).alias("archives"), F.lit(xff).alias("xff"), F.lit(method).alias("agg"))


def hourly(spark: SparkSession, sf_dir: str) -> stores.Store:
    """A store with one tier of hourly sums."""
    p = event_points(spark, sf_dir)
    slots = p.groupBy("key", (F.col("ts") - F.pmod("ts", F.lit(HOUR))).alias("ts")).agg(F.sum("value").alias("value"))
    points = slots.select("key", F.lit(0).alias("tier"), F.lit(HOUR).alias("step"), "ts", "value")
    tagged = F.create_map(F.lit("type"), F.split("key", r"\.")[1])
    catalog = event_catalog(p, "3600:90d").withColumn("tags", tagged)
    events = p.select("ts", F.array(F.split("key", r"\.")[1]).alias("tags"))
    return stores.Store(catalog, points, events=events)


def show(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    s = evaluate(hourly(spark, sf_dir), target, START - 1, NOW - 1, NOW, HOUR)
    return s.result().select("name", "ts", rounded("value").alias("value"))


def names(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    s = evaluate(hourly(spark, sf_dir), target, START - 1, NOW - 1, NOW, HOUR)
    return s.dim.select("name", "ordinal")


BASE = f"""
e AS (SELECT 'events.' || event_type || '.u' || user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS arrival FROM events),
pts AS (SELECT key AS name, ts - ts % {HOUR} AS ts, sum(value) AS value FROM e GROUP BY 1, 2),
t AS (SELECT split_part(name, '.', 2) AS name, ts, sum(value) AS value FROM pts GROUP BY 1, 2),
grid AS (SELECT unnest(range({START}, {NOW}, {HOUR})) AS ts),
d AS (SELECT name, ts, value, row_number() OVER (PARTITION BY name ORDER BY ts) - 1 AS i FROM (SELECT n.name, g.ts, t.value FROM (SELECT DISTINCT name FROM t) n CROSS JOIN grid g LEFT JOIN t ON t.name = n.name AND t.ts = g.ts))
"""


def _sql(body: str) -> str:
    return f"WITH {BASE} SELECT name::VARCHAR AS name, ts::BIGINT AS ts, round(value::DOUBLE + 1e-9, 6) AS value FROM ({body}) WHERE value IS NOT NULL"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _add(name: str, target: str, body: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: show(spark, sf_dir, target)
    if body:
        ORACLE_SQL[name] = _sql(body)


def _add_names(name: str, target: str, body: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: names(spark, sf_dir, target)
    ORACLE_SQL[name] = f"WITH {BASE} SELECT name::VARCHAR AS name, ordinal::BIGINT AS ordinal FROM ({body})"


# combine

for _n, _target, _agg in (
    ("fn_sum", "sumSeries(events.click.*)", "sum(value)"), ("fn_avg", "avgSeries(events.click.*)", "avg(value)"), ("fn_max", "maxSeries(events.click.*)", "max(value)"),
    ("fn_min", "minSeries(events.click.*)", "min(value)"), ("fn_range", "rangeOfSeries(events.click.*)", "max(value) - min(value)"), ("fn_stddev", "stddevSeries(events.click.*)", "stddev_pop(value)"),
    ("fn_median", 'aggregate(events.click.*,"median")', "quantile_cont(value, 0.5)"), ("fn_percentile", "percentileOfSeries(events.click.*,75)", "quantile_disc(value, 0.75)"),
    ("fn_percentile_interpolated", "percentileOfSeries(events.click.*,75,True)", "quantile_cont(value, 0.75)"), ("fn_last_across", 'aggregate(events.click.*,"last")', "arg_max(value, name)"),
    ("fn_diff", "diffSeries(events.click.*)", "2 * arg_min(value, name) - sum(value)"),
):
    _label = {"fn_sum": "sumSeries(events.click.*)", "fn_avg": "averageSeries(events.click.*)", "fn_median": "medianSeries(events.click.*)", "fn_last_across": "lastSeries(events.click.*)", "fn_percentile": "percentileOfSeries(events.click.*,75)", "fn_percentile_interpolated": "percentileOfSeries(events.click.*,75)"}.get(_n, _target)
    _add(_n, _target, f"SELECT '{_label}' AS name, ts, {_agg} AS value FROM pts WHERE name LIKE 'events.click.%' GROUP BY ts")

_add("fn_multiply", f"multiplySeries(scale({T},0.01))", f"SELECT 'multiplySeries(scale({T},0.01))' AS name, ts, product(value * 0.01) AS value FROM t GROUP BY ts")
_add("fn_count", f"countSeries({E})", f"SELECT 'countSeries({E})' AS name, ts, (SELECT count(DISTINCT name) FROM pts) AS value FROM grid")
_add("fn_scale", "scale(events.view.*,2.5)", "SELECT name, ts, value * 2.5 AS value FROM pts WHERE name LIKE 'events.view.%'")
_add("fn_nested", "scale(sumSeries(events.{click,view}.*,events.signup.*),-2)", "SELECT 'sumSeries(events.{click,view}.*,events.signup.*)' AS name, ts, -2 * sum(value) AS value FROM pts WHERE split_part(name, '.', 2) IN ('click', 'view', 'signup') GROUP BY ts")
_add("fn_group_by_node", 'groupByNode(events.*.*,2,"max")', "SELECT split_part(name, '.', 3) AS name, ts, max(value) AS value FROM pts GROUP BY 1, 2")
_add("fn_group_by_nodes", 'groupByNodes(events.*.*,"average",1,0)', "SELECT split_part(name, '.', 2) || '.' || split_part(name, '.', 1) AS name, ts, avg(value) AS value FROM pts GROUP BY 1, 2")
_add("fn_group_by_tags", 'groupByTags(events.*.*,"sum","type")', "SELECT name, ts, value FROM t")
_add("fn_sum_with_wildcards", "sumSeriesWithWildcards(events.*.*,2)", "SELECT 'events.' || name AS name, ts, value FROM t")
_add("fn_average_with_wildcards", "averageSeriesWithWildcards(events.*.*,0,2)", "SELECT split_part(name, '.', 2) AS name, ts, avg(value) AS value FROM pts GROUP BY 1, 2")
_add("fn_multiply_with_wildcards", f"multiplySeriesWithWildcards(scale({T},0.01),0)", "SELECT '' AS name, ts, product(value * 0.01) AS value FROM t GROUP BY ts")
_add("fn_aggregate_xff", 'aggregate(events.click.*,"sum",0.02)', "SELECT 'sumSeries(events.click.*)' AS name, ts, sum(value) AS value FROM pts WHERE name LIKE 'events.click.%' GROUP BY ts HAVING count(*) >= 0.02 * (SELECT count(DISTINCT name) FROM pts WHERE name LIKE 'events.click.%')")
_add("fn_as_percent", f"asPercent({T})", "SELECT 'asPercent(' || name || ')' AS name, ts, 100 * value / sum(value) OVER (PARTITION BY ts) AS value FROM t")
_add("fn_as_percent_number", f"asPercent({T},200)", "SELECT 'asPercent(' || name || ',200)' AS name, ts, 100 * value / 200 AS value FROM t")
_add("fn_as_percent_nodes", "asPercent(events.*.*,None,1)", "SELECT 'asPercent(' || name || ',None)' AS name, ts, 100 * value / nullif(sum(value) OVER (PARTITION BY ts, split_part(name, '.', 2)), 0) AS value FROM pts")
_add("fn_divide", f"divideSeries({T},sumSeries({E}))", f"SELECT 'divideSeries(' || name || ',sumSeries({E}))' AS name, ts, value / sum(value) OVER (PARTITION BY ts) AS value FROM t")
_add("fn_divide_lists", f"divideSeriesLists({T},offset({T},1))", "SELECT 'divideSeries(' || name || ',offset(' || name || ',1))' AS name, ts, value / (value + 1) AS value FROM t")
_add("fn_weighted_average", 'weightedAverage(groupByNode(events.*.*,1,"average"),groupByNode(events.*.*,1,"count"),0)', 'SELECT \'weightedAverage(groupByNode(events.*.*,1,"average"),groupByNode(events.*.*,1,"count"),0)\' AS name, ts, sum(a * n) / sum(n) AS value FROM (SELECT split_part(name, \'.\', 2) AS k, ts, avg(value) AS a, count(*) AS n FROM pts GROUP BY 1, 2) GROUP BY ts')
_add("fn_is_non_null", f"isNonNull({T})", "SELECT 'isNonNull(' || name || ')' AS name, ts, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS value FROM d")
_add("fn_apply_by_node", 'applyByNode(events.*.*,1,"sumSeries(%.*)","%.total")', "SELECT 'events.' || name || '.total' AS name, ts, value FROM t")
_add("fn_group", "group(events.click.*,events.view.*)", "SELECT name, ts, value FROM pts WHERE split_part(name, '.', 2) IN ('click', 'view')")

# filter points and series

_add("fn_remove_above_value", f"removeAboveValue({T},80)", "SELECT 'removeAboveValue(' || name || ',80)' AS name, ts, CASE WHEN value <= 80 THEN value END AS value FROM t")
_add("fn_remove_below_value", f"removeBelowValue({T},80)", "SELECT 'removeBelowValue(' || name || ',80)' AS name, ts, CASE WHEN value >= 80 THEN value END AS value FROM t")
_add("fn_remove_above_percentile", f"removeAbovePercentile({T},60)", "SELECT 'removeAbovePercentile(' || name || ',60)' AS name, ts, CASE WHEN value <= p THEN value END AS value FROM t JOIN (SELECT name, quantile_cont(value, 0.6) AS p FROM t GROUP BY name) USING (name)")
_add("fn_remove_below_percentile", f"removeBelowPercentile({T},60)", "SELECT 'removeBelowPercentile(' || name || ',60)' AS name, ts, CASE WHEN value >= p THEN value END AS value FROM t JOIN (SELECT name, quantile_cont(value, 0.6) AS p FROM t GROUP BY name) USING (name)")
for _n, _f, _stat, _op, _x in (
    ("fn_average_above", "averageAbove", "avg(value)", ">", 40), ("fn_average_below", "averageBelow", "avg(value)", "<", 15), ("fn_current_above", "currentAbove", "arg_max(value, ts)", ">", 60),
    ("fn_current_below", "currentBelow", "arg_max(value, ts)", "<", 3), ("fn_maximum_above", "maximumAbove", "max(value)", ">", 200), ("fn_maximum_below", "maximumBelow", "max(value)", "<", 30),
    ("fn_minimum_above", "minimumAbove", "min(value)", ">", 5), ("fn_minimum_below", "minimumBelow", "min(value)", "<", 0.1),
):
    _add(_n, f"{_f}({E},{_x})", f"SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name HAVING {_stat} {_op} {_x})")
_add("fn_filter_series", f'filterSeries({E},"range",">=",150)', "SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name HAVING max(value) - min(value) >= 150)")
for _n, _f, _stat, _dir in (
    ("fn_highest_max", "highestMax", "max(value)", "DESC"), ("fn_highest_average", "highestAverage", "avg(value)", "DESC"), ("fn_highest_current", "highestCurrent", "arg_max(value, ts)", "DESC"),
    ("fn_lowest_average", "lowestAverage", "avg(value)", "ASC"), ("fn_lowest_current", "lowestCurrent", "arg_max(value, ts)", "ASC"), ("fn_most_deviant", "mostDeviant", "stddev_pop(value)", "DESC"),
):
    _add(_n, f"{_f}({E},5)", f"SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name ORDER BY {_stat} {_dir}, name LIMIT 5)")
_add("fn_highest", f'highest({E},4,"sum")', "SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name ORDER BY sum(value) DESC, name LIMIT 4)")
_add("fn_lowest", f'lowest({E},4,"max")', "SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name ORDER BY max(value), name LIMIT 4)")
_add("fn_limit", f"limit({E},7)", "SELECT name, ts, value FROM pts WHERE name IN (SELECT DISTINCT name FROM pts ORDER BY name LIMIT 7)")
_add("fn_grep", f'grep({E},"u1[0-3]$")', "SELECT name, ts, value FROM pts WHERE regexp_matches(name, 'u1[0-3]$')")
_add("fn_exclude", f'exclude({E},"click|view")', "SELECT name, ts, value FROM pts WHERE NOT regexp_matches(name, 'click|view')")
_add("fn_unique", "unique(events.click.*,events.*.u1)", "SELECT name, ts, value FROM pts WHERE name LIKE 'events.click.%' OR name LIKE 'events.%.u1'")
_add("fn_remove_empty", f"removeEmptySeries({E},0.02)", f"SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts GROUP BY name HAVING count(value) >= 0.02 * {(NOW - START) // HOUR})")
_add("fn_average_outside_percentile", f"averageOutsidePercentile({E},95)", "SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM (SELECT name, avg(value) AS a FROM pts GROUP BY name), (SELECT quantile_cont(a, 0.05) AS lo, quantile_cont(a, 0.95) AS hi FROM (SELECT avg(value) AS a FROM pts GROUP BY name)) WHERE a <= lo OR a >= hi)")
_add("fn_remove_between_percentile", "removeBetweenPercentile(events.click.*,70)", "SELECT name, ts, value FROM pts WHERE name IN (SELECT name FROM pts JOIN (SELECT ts, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM pts WHERE name LIKE 'events.click.%' GROUP BY ts) USING (ts) WHERE name LIKE 'events.click.%' AND (value < lo OR value > hi))")
_add("fn_use_series_above", 'useSeriesAbove(events.click.*,200,"click","view")', "SELECT name, ts, value FROM pts WHERE name IN (SELECT replace(name, 'click', 'view') FROM pts WHERE name LIKE 'events.click.%' GROUP BY name HAVING max(value) > 200)")
_add("fn_series_by_tag", 'seriesByTag("type=~cl","type!=error")', "SELECT name, ts, value FROM pts WHERE split_part(name, '.', 2) = 'click'")
_add("fn_fallback", "fallbackSeries(events.none.*,events.click.u1)", "SELECT name, ts, value FROM pts WHERE name = 'events.click.u1'")

# transform

for _n, _target, _v in (
    ("fn_absolute", f"absolute(offset({T},-80))", None), ("fn_invert", f"invert({T})", "1 / nullif(value, 0)"), ("fn_square_root", f"squareRoot({T})", "sqrt(value)"),
    ("fn_log", f"log({T})", "CASE WHEN value > 0 THEN log10(value) END"), ("fn_log_base", f"log({T},2)", "CASE WHEN value > 0 THEN ln(value) / ln(2) END"), ("fn_pow", f"pow({T},2)", "value ** 2"),
    ("fn_offset", f"offset({T},12.5)", "value + 12.5"), ("fn_round", f"round(offset({T},0.001),1)", None), ("fn_scale_to_seconds", f"scaleToSeconds({T},60)", "value * 60 / 3600"),
):
    _tail = _target[_target.rindex('"') + 2 :]
    _f = _target[: _target.index("(")]
    _add(_n, _target, f"SELECT '{_f}(' || name || '{_tail}' AS name, ts, {_v} AS value FROM t" if _v else None)
ORACLE_SQL["fn_absolute"] = _sql("SELECT 'absolute(offset(' || name || ',-80))' AS name, ts, abs(value - 80) AS value FROM t")
ORACLE_SQL["fn_round"] = _sql("SELECT 'round(offset(' || name || ',0.001),1)' AS name, ts, round(value + 0.001, 1) AS value FROM t")

W = "OVER (PARTITION BY name ORDER BY ts)"
_add("fn_delay", f"delay({T},3)", f"SELECT 'delay(' || name || ',3)' AS name, ts, lag(value, 3) {W} AS value FROM d")
_add("fn_derivative", f"derivative({T})", f"SELECT 'derivative(' || name || ')' AS name, ts, value - lag(value) {W} AS value FROM d")
_add("fn_nonneg_derivative", f"nonNegativeDerivative({T})", f"SELECT 'nonNegativeDerivative(' || name || ')' AS name, ts, CASE WHEN value - lag(value) {W} >= 0 THEN value - lag(value) {W} END AS value FROM d")
_add("fn_per_second", f"perSecond({T},1000)", f"SELECT 'perSecond(' || name || ')' AS name, ts, CASE WHEN value > 1000 THEN NULL WHEN value - p >= 0 THEN value - p ELSE 1000 - p + value + 1 END / 3600 AS value FROM (SELECT *, lag(value) {W} AS p FROM d)")
_add("fn_integral", f"integral({T})", f"SELECT 'integral(' || name || ')' AS name, ts, sum(value) OVER (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM t")
_add("fn_integral_by_interval", f'integralByInterval({T},"1d")', f"SELECT 'integralByInterval(' || name || ',''1d'')' AS name, ts, sum(value) OVER (PARTITION BY name, (ts - {START}) // 86400 ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM t")
NEAR = "SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, max(i) OVER (PARTITION BY name) AS n FROM d WINDOW b AS (PARTITION BY name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY name ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_add("fn_keep_last_value", f"keepLastValue({T},2)", f"SELECT 'keepLastValue(' || name || ')' AS name, ts, coalesce(value, CASE WHEN coalesce(i1, n + 1) - i0 - 1 <= 2 THEN v0 END) AS value FROM ({NEAR})")
_add("fn_interpolate", f"interpolate({T})", f"SELECT 'interpolate(' || name || ')' AS name, ts, coalesce(value, v0 + (v1 - v0) * (i - i0) / (i1 - i0)) AS value FROM ({NEAR})")
_add("fn_transform_null", f"transformNull({T},-1)", "SELECT 'transformNull(' || name || ',-1)' AS name, ts, coalesce(value, -1) AS value FROM d")
_add("fn_changed", f"changed({T})", "SELECT 'changed(' || name || ')' AS name, ts, CASE WHEN coalesce(value <> p, false) THEN 1 ELSE 0 END AS value FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d)")
_add("fn_min_max", f"minMax({T})", "SELECT 'minMax(' || name || ')' AS name, ts, (value - min(value) OVER (PARTITION BY name)) / (max(value) OVER (PARTITION BY name) - min(value) OVER (PARTITION BY name)) AS value FROM t")
_add("fn_offset_to_zero", f"offsetToZero({T})", "SELECT 'offsetToZero(' || name || ')' AS name, ts, value - min(value) OVER (PARTITION BY name) AS value FROM t")
_add("fn_summarize", f'summarize({T},"1d","max")', "SELECT 'summarize(' || name || ',''1d'',''max'')' AS name, ts - ts % 86400 AS ts, max(value) AS value FROM t GROUP BY 1, 2")
_add("fn_smart_summarize", f'smartSummarize({T},"7h","average")', f"SELECT 'smartSummarize(' || name || ',''7h'',''average'')' AS name, {START} + (ts - {START}) // 25200 * 25200 AS ts, avg(value) AS value FROM t GROUP BY 1, 2")
_add("fn_hitcount", f'hitcount({T},"90min")', f"SELECT 'hitcount(' || name || ',''90min'')' AS name, {START} + b * 5400 AS ts, sum(value * (least(ts + 3600, {START} + (b + 1) * 5400) - greatest(ts, {START} + b * 5400))) AS value FROM (SELECT *, unnest(range((ts - {START}) // 5400, (ts + 3599 - {START}) // 5400 + 1)) AS b FROM t) GROUP BY 1, 2")
_add("fn_time_shift", f'timeShift({T},"1d")', f"SELECT 'timeShift(' || name || ',''1d'')' AS name, ts + 86400 AS ts, value FROM t WHERE ts + 86400 < {NOW}")
_add("fn_time_stack", f'timeStack({T},"1d",1,3)', f"SELECT 'timeShift(' || name || ',''1d'',' || k || ')' AS name, ts + 86400 * k AS ts, value FROM t, (SELECT unnest([1, 2, 3]) AS k) WHERE ts + 86400 * k < {NOW}")
_add("fn_time_slice", f'timeSlice({T},{START + 864000},"-5d")', f"SELECT 'timeSlice(' || name || ',{START + 864000},{NOW - 432000})' AS name, ts, value FROM t WHERE ts BETWEEN {START + 864000} AND {NOW - 432000}")
_add("fn_stacked", f"stacked({T})", "SELECT 'stacked(' || name || ')' AS name, ts, sum(value) OVER (PARTITION BY ts ORDER BY name ROWS UNBOUNDED PRECEDING) AS value FROM t")
_add("fn_constant_line", "constantLine(12.5)", "SELECT '12.5' AS name, ts, 12.5 AS value FROM grid")
QUERIES["fn_constant_line"] = lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), "constantLine(12.5)", START, NOW, NOW, HOUR).result()
_add("fn_identity", 'identity("x")', "SELECT 'x' AS name, ts, ts AS value FROM grid")
QUERIES["fn_identity"] = lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), 'identity("x")', START, NOW, NOW, HOUR).result().select("name", "ts", rounded("value").alias("value"))
_add("fn_events", 'events("click")', f"SELECT 'events(click)' AS name, {START} + (ts - {START}) // 3600 * 3600 AS ts, count(*) AS value FROM e WHERE key LIKE 'events.click.%' GROUP BY 1, 2")
QUERIES["fn_events"] = lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), 'events("click")', START, NOW, NOW, HOUR).result()

# calculate

PRIOR = "(PARTITION BY name ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
for _n, _f, _v in (("fn_moving_average", "movingAverage", "avg(value)"), ("fn_moving_max", "movingMax", "max(value)"), ("fn_moving_min", "movingMin", "min(value)"), ("fn_moving_sum", "movingSum", "sum(value)"), ("fn_moving_median", "movingMedian", "quantile_cont(value, 0.5)")):
    _add(_n, f"{_f}({T},5)", f"SELECT '{_f}(' || name || ',5)' AS name, ts, {_v} OVER {PRIOR} AS value FROM d")
_add("fn_moving_window", f'movingWindow({T},"5h","range",0.9)', f"SELECT 'movingRange(' || name || ',''5h'')' AS name, ts, CASE WHEN count(value) OVER {PRIOR} >= 0.9 * 5 THEN max(value) OVER {PRIOR} - min(value) OVER {PRIOR} END AS value FROM d")
_add("fn_stdev", f"stdev({T},6,0.2)", "SELECT 'stdev(' || name || ',6)' AS name, ts, CASE WHEN count(value) OVER w > 0 AND (count(*) OVER w - count(value) OVER w) / 6.0 <= 0.2 THEN stddev_pop(value) OVER w END AS value FROM d WINDOW w AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
_add("fn_aggregate_line", f'aggregateLine({T},"max")', "SELECT 'aggregateLine(' || name || ',''max'')' AS name, ts, max(value) OVER (PARTITION BY name) AS value FROM d")
_add("fn_npercentile", f"nPercentile({T},90)", "SELECT 'nPercentile(' || name || ',90)' AS name, ts, p AS value FROM d JOIN (SELECT name, quantile_cont(value, 0.9) AS p FROM t GROUP BY name) USING (name)")
_add("fn_linear_regression", f"linearRegression({T})", f"SELECT 'linearRegression(' || name || ')' AS name, ts, a + b * (ts - {START}) AS value FROM d JOIN (SELECT name, regr_slope(value, ts - {START}) AS b, regr_intercept(value, ts - {START}) AS a FROM t GROUP BY name) USING (name)")
_add("fn_ema", f"exponentialMovingAverage({T},10)", None)
_add("fn_holt_winters_forecast", f"holtWintersForecast({T})", None)
_add("fn_holt_winters_bands", f"holtWintersConfidenceBands({T})", None)
_add("fn_holt_winters_area", f"holtWintersConfidenceArea({T})", None)
_add("fn_holt_winters_aberration", f"holtWintersAberration({T})", None)

# names and order

_add("fn_alias_by_node", "aliasByNode(events.click.*,2,0)", "SELECT split_part(name, '.', 3) || '.events' AS name, ts, value FROM pts WHERE name LIKE 'events.click.%'")
_add("fn_alias_sub", r'aliasSub(events.click.*,"^.*u(\d+)","user \1")', r"SELECT regexp_replace(name, '^.*u(\d+)', 'user \1') AS name, ts, value FROM pts WHERE name LIKE 'events.click.%'")
_add("fn_alias_by_metric", "aliasByMetric(events.view.*)", "SELECT split_part(name, '.', 3) AS name, ts, value FROM pts WHERE name LIKE 'events.view.%'")
_add("fn_alias", 'alias(events.view.u1,"one")', "SELECT 'one' AS name, ts, value FROM pts WHERE name = 'events.view.u1'")
_add("fn_substr", "substr(events.click.*,1,3)", "SELECT substr(name, 8) AS name, ts, value FROM pts WHERE name LIKE 'events.click.%'")
_add_names("fn_sort_by_total", f"sortByTotal({T})", "SELECT name, row_number() OVER (ORDER BY sum(value) DESC, name) AS ordinal FROM t GROUP BY name")
_add_names("fn_sort_by_maxima", f"sortByMaxima({E})", "SELECT name, row_number() OVER (ORDER BY max(value) DESC, name) AS ordinal FROM pts GROUP BY name")
_add_names("fn_sort_by_minima", f"sortByMinima({E})", "SELECT name, row_number() OVER (ORDER BY min(value), name) AS ordinal FROM pts GROUP BY name HAVING max(value) > 0")
_add_names("fn_sort_by_name", f"sortByName({E},True)", r"SELECT name, row_number() OVER (ORDER BY split_part(name, '.', 2), CAST(substr(split_part(name, '.', 3), 2) AS INT)) AS ordinal FROM (SELECT DISTINCT name FROM pts)")
_add_names("fn_sort_by", f'sortBy({E},"count",True)', "SELECT name, row_number() OVER (ORDER BY count(value) DESC, name) AS ordinal FROM pts GROUP BY name")
_add_names("fn_legend_value", "legendValue(events.click.*,'max','si')", "SELECT name || ' (max: ' || printf('%.2f', max(value)) || ')' AS name, 0 AS ordinal FROM pts WHERE name LIKE 'events.click.%' GROUP BY name")
_add_names("fn_cacti_style", f"cactiStyle({T})", "SELECT name || ' Current:' || printf('%.2f', arg_max(value, ts)) || ' Max:' || printf('%.2f', max(value)) || ' Min:' || printf('%.2f', min(value)) AS name, 0 AS ordinal FROM t GROUP BY name")

# globs and finding

KEYS = "k AS (SELECT DISTINCT key FROM e)"


def _globbed(pattern: str):
    return lambda spark, sf_dir: event_points(spark, sf_dir).select("key").distinct().where(glob.condition(F.col("key"), pattern))


for _n, _p, _c in (
    ("glob_star", "events.*.u1*", "regexp_matches(key, '^events\\.[^.]*\\.u1[^.]+$')"),
    ("glob_class", "events.[cv]*.u[12][05]", "regexp_matches(key, '^events\\.[cv][^.]*\\.u[12][05]$')"),
    ("glob_braces", "events.{click,sign}{up,}*.u7", "false"),
    ("glob_any", "events.**5", "false"),
    ("glob_deep", "**.u12", "regexp_matches(key, '^.*\\.u12$')"),
):
    query(_n, f"WITH {BASE}, {KEYS} SELECT key FROM k WHERE {_c}")(_globbed(_p))
ORACLE_SQL["glob_braces"] = f"WITH {BASE}, {KEYS} SELECT key FROM k WHERE regexp_matches(key, '^events\\.(click|sign)up[^.]*\\.u7$')"
ORACLE_SQL["glob_any"] = f"WITH {BASE}, {KEYS} SELECT key FROM k WHERE regexp_matches(key, '^events\\..*5$')"


def _found(*patterns: str):
    return lambda spark, sf_dir: cat.find(event_catalog(event_points(spark, sf_dir)), list(patterns))[0]


query("find_level", f"WITH {BASE}, {KEYS} SELECT 'events.click.u1*' AS pattern, key AS name, false AS is_directory FROM k WHERE regexp_matches(key, '^events\\.click\\.u1[^.]+$')")(_found("events.click.u1*"))
query("find_dirs", f"WITH {BASE}, {KEYS} SELECT DISTINCT 'events.*' AS pattern, 'events.' || split_part(key, '.', 2) || '.*' AS name, true AS is_directory FROM k UNION ALL SELECT '*', 'events.*', true")(_found("events.*", "*"))
query("find_recursive", f"WITH {BASE}, {KEYS} SELECT 'events.c*.**' AS pattern, key AS name, false AS is_directory FROM k WHERE split_part(key, '.', 2) LIKE 'c_%'")(_found("events.c*.**"))

# writing, rolling up, reading


def written(spark: SparkSession, sf_dir: str, method: int = 2, xff: float = 0.0, archives: str = TIERS, now: int = NOW) -> stores.Store:
    p = event_points(spark, sf_dir)
    s = stores.Store(event_catalog(p, archives, method, xff), spark.createDataFrame([], cat.POINTS))
    s.write(p, now)
    return s


SLOTS = """slots AS (SELECT key, ts - ts % 60 AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts - ts % 60 ORDER BY ts, arrival DESC) AS rn FROM e) WHERE rn = 1)"""


def _rows(s: stores.Store) -> DataFrame:
    return s.points.select("key", "tier", "step", "ts", rounded("value").alias("value"))


@query("write_slot_dedup", f"WITH {BASE}, {SLOTS} SELECT key, 0 AS tier, 60 AS step, ts, round(value + 1e-9, 6) AS value FROM slots")
def write_slot_dedup(spark, sf_dir):
    return _rows(written(spark, sf_dir)).where("tier = 0")


for _m, (_name, _v) in {1: ("avg", "avg(value)"), 2: ("sum", "sum(value)"), 3: ("last", "arg_max(value, ts)"), 4: ("min", "min(value)"), 5: ("max", "max(value)")}.items():
    _up = " UNION ALL ".join(f"SELECT key, {j} AS tier, {step} AS step, ts - ts % {step} AS ts, round({_v} + 1e-9, 6) AS value FROM slots GROUP BY key, ts - ts % {step}" for j, step in ((1, 3600), (2, 86400)))
    query(f"rollup_{_name}", f"WITH {BASE}, {SLOTS} {_up}")(lambda spark, sf_dir, _m=_m: _rows(written(spark, sf_dir, _m)).where("tier > 0"))

query("rollup_xff_gate", f"WITH {BASE}, {SLOTS} SELECT key, 1 AS tier, 86400 AS step, ts - ts % 86400 AS ts, round(sum(value) + 1e-9, 6) AS value FROM slots GROUP BY key, ts - ts % 86400 HAVING count(*) >= 0.0015 * 1440")(lambda spark, sf_dir: _rows(written(spark, sf_dir, 2, 0.0015, "60:31d,86400:365d")).where("tier = 1"))


_AGED = f"SELECT *, CASE WHEN {NOW} - ts <= 432000 THEN 0 WHEN {NOW} - ts <= 1296000 THEN 1 ELSE 2 END AS tier FROM e WHERE {NOW} - ts <= 2160000"


@query("tier_by_age", f"""WITH {BASE}, a AS ({_AGED}), p AS (SELECT *, [60, 3600, 86400][tier + 1] AS step FROM a)
SELECT key, tier, step, ts - ts % step AS ts, round(value + 1e-9, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key, tier, ts - ts % step ORDER BY ts, arrival DESC) AS rn FROM p) WHERE rn = 1""")
def tier_by_age(spark, sf_dir):
    p = event_points(spark, sf_dir)
    c = event_catalog(p, "60:5d,3600:15d,86400:25d").select("key", "archives")
    return ingest.place(p.join(c, "key"), NOW).select("key", "tier", "step", "ts", rounded("value").alias("value"))


@query("read_window_snap", f"WITH {BASE}, {SLOTS} SELECT 'events.view.*' AS query, key AS name, ts, round(value + 1e-9, 6) AS value FROM slots WHERE key LIKE 'events.view.%' AND ts >= {START + 90000 + 35 - (START + 90035) % 60 + 60} AND ts < {NOW - 100 - (NOW - 100) % 60 + 60}")
def read_window_snap(spark, sf_dir):
    s = written(spark, sf_dir)
    return s.read(["events.view.*"], START + 90035, NOW - 100, NOW)[1].select("query", "name", "ts", rounded("value").alias("value"))


@query("read_missing", f"SELECT 'events.none.u1' AS query, 'events.none.u1' AS name, 0::BIGINT AS step, {START}::BIGINT AS start_time, {NOW}::BIGINT AS end_time")
def read_missing(spark, sf_dir):
    return written(spark, sf_dir).read(["events.none.u1"], START, NOW, NOW)[0]


@query("overlay_read", f"""WITH {BASE}, a AS (SELECT * FROM e WHERE arrival % 2 = 0), b AS (SELECT * FROM e WHERE arrival % 2 = 1),
stored AS (SELECT key, ts - ts % 3600 AS ts, sum(value) AS value FROM (SELECT key, ts - ts % 60 AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts - ts % 60 ORDER BY ts, arrival DESC) AS rn FROM a) WHERE rn = 1) GROUP BY 1, 2),
top AS (SELECT key, ts - ts % 3600 AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts - ts % 3600 ORDER BY ts DESC, arrival DESC) AS rn FROM b WHERE key IN (SELECT key FROM a)) WHERE rn = 1)
SELECT 'events.*.*' AS query, key AS name, ts, round(value + 1e-9, 6) AS value FROM (SELECT * FROM top UNION ALL SELECT * FROM stored WHERE (key, ts) NOT IN (SELECT (key, ts) FROM top))""")
def overlay_read(spark, sf_dir):
    p = event_points(spark, sf_dir)
    a, b = p.where("arrival % 2 = 0"), p.where("arrival % 2 = 1")
    # everything is older than a day but for the newest: written finely, then rolled up
    s = stores.Store(event_catalog(a, "60:31d,3600:90d"), spark.createDataFrame([], cat.POINTS))
    s.write(a, NOW)
    s.catalog = event_catalog(a, "60:29d,3600:90d")
    head, data = s.read(["events.*.*"], START - 1, NOW - 1, NOW)
    return read.overlay_pending(head, data, b, START - 1, NOW - 1).select("query", "name", "ts", rounded("value").alias("value"))


RULES = [("events.{click,view}.*", "60:1d", 0.0, "sum"), ("events.**", "300:30d", 0.5, "max"), ("**", "60:90d", 0.0, "average")]


@query("autocreate_rule_match", f"""WITH {BASE}, {KEYS} SELECT key, CASE WHEN split_part(key, '.', 2) IN ('click', 'view') THEN 60 ELSE 300 END AS step, CASE WHEN split_part(key, '.', 2) IN ('click', 'view') THEN 1440 ELSE 8640 END AS points,
CASE WHEN split_part(key, '.', 2) IN ('click', 'view') THEN 0.0 ELSE 0.5 END::DOUBLE AS xff, CASE WHEN split_part(key, '.', 2) IN ('click', 'view') THEN 2 ELSE 5 END AS agg FROM k""")
def autocreate_rule_match(spark, sf_dir):
    c = ingest.created(event_points(spark, sf_dir).select("key").distinct(), RULES)
    return c.select("key", F.get("archives", F.lit(0))["precision"].alias("step"), F.get("archives", F.lit(0))["points"].alias("points"), "xff", "agg")


@query("resample_update", f"""WITH {BASE}, {SLOTS}
SELECT key, 0 AS tier, 600 AS step, ts - ts % 600 AS ts, round(value + 1e-9, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts - ts % 600 ORDER BY ts) AS rn FROM slots) WHERE rn = 1""")
def resample_update(spark, sf_dir):
    s = written(spark, sf_dir, archives="60:31d")
    s.update_metadata(event_catalog(event_points(spark, sf_dir), "600:31d"), cat.UPDATE, now=NOW)
    return _rows(s)


@query("rename_merge", f"""WITH {BASE}, {SLOTS}, one AS (SELECT ts, value FROM slots WHERE key = 'events.click.u1'), two AS (SELECT ts, value FROM slots WHERE key = 'events.click.u2')
SELECT key, 0 AS tier, 60 AS step, ts, round(value + 1e-9, 6) AS value FROM (SELECT 'events.click.u2' AS key, * FROM one UNION ALL SELECT 'events.click.u2', * FROM two WHERE ts NOT IN (SELECT ts FROM one) UNION ALL SELECT key, ts, value FROM slots WHERE key NOT IN ('events.click.u1', 'events.click.u2'))""")
def rename_merge(spark, sf_dir):
    s = written(spark, sf_dir, archives="60:31d")
    s.rename_series([("events.click.u1", "events.click.u2")], merge=True, now=NOW)
    return _rows(s)


@query("delete_glob", f"WITH {BASE}, {SLOTS} SELECT key, 0 AS tier, 60 AS step, ts, round(value + 1e-9, 6) AS value FROM slots WHERE NOT regexp_matches(key, '^events\\.click\\.u1[^.]+$') AND key NOT LIKE 'events.view.%'")
def delete_glob(spark, sf_dir):
    s = written(spark, sf_dir, archives="60:31d")
    s.delete_series(["events.click.u1*", "events.view.**"])
    return _rows(s)


PLACES = [("10.0.0.1", "a"), ("10.0.0.2", "b"), ("10.0.0.3", "c")]
_RING = stores.ring(PLACES)
_RUNS = ", ".join(f"({p}, {s})" for p, s in _RING)
_PLACED = f"WITH {BASE}, {KEYS}, ring(p, s) AS (VALUES {_RUNS}), spot AS (SELECT key, ('0x' || md5(key)[1:4])::INT AS h FROM k), placed AS (SELECT key, coalesce((SELECT arg_min(s, p) FROM ring WHERE p >= h), (SELECT arg_min(s, p) FROM ring)) AS store FROM spot)"


@query("hash_placement", f"{_PLACED} SELECT key, store::INT AS store FROM placed")
def hash_placement(spark, sf_dir):
    return stores.place_keys(event_points(spark, sf_dir).select("key").distinct(), _RING)


@query("verify_moves", f"{_PLACED}, actual AS (SELECT key, (length(key) % 3)::INT AS store FROM k) SELECT key, a.store, p.store::INT AS wanted FROM actual a JOIN placed p USING (key) WHERE a.store <> p.store")
def verify_moves(spark, sf_dir):
    actual = event_points(spark, sf_dir).select("key").distinct().withColumn("store", (F.length("key") % 3).cast("int"))
    return stores.verify(actual, _RING)


# the write buffer and stores that share keys

_LATE = f"""{SLOTS.replace("slots AS", "early AS").replace("FROM e)", "FROM e WHERE arrival % 2 = 0)")}, {SLOTS.replace("slots AS", "late AS").replace("FROM e)", "FROM (SELECT key, ts, arg_max(value, arrival) AS value, max(arrival) AS arrival FROM e WHERE arrival % 2 = 1 GROUP BY key, ts))")}"""


def _buffered(spark: SparkSession, sf_dir: str, archives: str = "60:31d") -> buffer.BufferedStore:
    """Even arrivals stored, odd ones queued."""
    p = event_points(spark, sf_dir)
    s = stores.Store(event_catalog(p, archives), spark.createDataFrame([], cat.POINTS))
    s.write(p.where("arrival % 2 = 0"), NOW)
    out = buffer.BufferedStore(s)
    out.write(p.where("arrival % 2 = 1"), NOW)
    return out


@query("buffer_flush", f"WITH {BASE}, {_LATE} SELECT key, 0 AS tier, 60 AS step, ts, round(value + 1e-9, 6) AS value FROM (SELECT * FROM late UNION ALL SELECT * FROM early WHERE (key, ts) NOT IN (SELECT (key, ts) FROM late))")
def buffer_flush(spark, sf_dir):
    b = _buffered(spark, sf_dir)
    b.flush(NOW)
    return _rows(b.store)


@query("buffered_read", f"""WITH {BASE}, {_LATE}, top AS (SELECT key, ts - ts % 60 AS ts, arg_max(value, ts) AS value FROM (SELECT key, ts, arg_max(value, arrival) AS value FROM e WHERE arrival % 2 = 1 GROUP BY key, ts) GROUP BY 1, 2)
SELECT 'events.*.*' AS query, key AS name, ts, round(value + 1e-9, 6) AS value FROM (SELECT * FROM top UNION ALL SELECT * FROM early WHERE (key, ts) NOT IN (SELECT (key, ts) FROM top)) WHERE ts >= {START}""")
def buffered_read(spark, sf_dir):
    return _buffered(spark, sf_dir).read(["events.*.*"], START - 1, NOW - 1, NOW)[1].select("query", "name", "ts", rounded("value").alias("value"))


@query("find_overlay", f"""WITH {BASE}, {KEYS} SELECT DISTINCT 'events.*' AS pattern, 'events.' || split_part(key, '.', 2) || '.*' AS name, true AS is_directory FROM k
UNION ALL SELECT 'events.*.u1*', key, false FROM k WHERE regexp_matches(key, '^events\\.[^.]*\\.u1[^.]+$')""")
def find_overlay(spark, sf_dir):
    c = event_catalog(event_points(spark, sf_dir))
    b = buffer.BufferedStore(stores.Store(c.where("key NOT LIKE 'events.click.%'"), spark.createDataFrame([], cat.POINTS)))
    b.update_metadata(c.where("key LIKE 'events.click.%'"))
    return b.find(["events.*", "events.*.u1*"])[0]


def _ringed(spark: SparkSession, sf_dir: str, archives: str = "60:31d") -> stores.RingStore:
    none = spark.createDataFrame([], cat.CATALOG), spark.createDataFrame([], cat.POINTS)
    return stores.RingStore([stores.Store(*none) for _ in PLACES], places=PLACES)


@query("routed_read", f"WITH {BASE}, {SLOTS} SELECT 'events.*.*' AS query, key AS name, ts, round(value + 1e-9, 6) AS value FROM slots WHERE ts >= {START} AND ts < {NOW}")
def routed_read(spark, sf_dir):
    p = event_points(spark, sf_dir)
    r = _ringed(spark, sf_dir)
    r.update_metadata(event_catalog(p, "60:31d"), create_new=True)
    r.write(p, NOW)
    return r.read(["events.*.*"], START - 1, NOW - 1, NOW)[1].select("query", "name", "ts", rounded("value").alias("value"))


@query("repair", f"{_PLACED}, {SLOTS} SELECT store::INT AS store, key, ts, round(value + 1e-9, 6) AS value FROM slots JOIN placed USING (key)")
def repair(spark, sf_dir):
    p = event_points(spark, sf_dir)
    r = _ringed(spark, sf_dir)
    for k, s in enumerate(r.stores):
        own = p.where(F.length("key") % 3 == k)
        s.update_metadata(event_catalog(own, "60:31d"))
        s.write(own, NOW)
    r.verify(repair=True, now=NOW)
    out = None
    for k, s in enumerate(r.stores):
        rows = s.points.select(F.lit(k).alias("store"), "key", "ts", rounded("value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# sources and sinks


@query("json_render", f"WITH {BASE} SELECT name, count(*) AS points, min(ts) AS first, max(ts) AS last FROM pts GROUP BY name")
def json_render(spark, sf_dir):
    """Every series as its JSON object, read again."""
    s = evaluate(hourly(spark, sf_dir), E, START - 1, NOW - 1, NOW, HOUR)
    j = F.from_json("json", "target string, datapoints array<array<double>>")
    times = F.transform("j.datapoints", lambda p: p[1].cast("bigint"))
    return sinks.json_targets(s).select(j.alias("j")).select(F.col("j.target").alias("name"), F.size("j.datapoints").cast("bigint").alias("points"), F.array_min(times).alias("first"), F.array_max(times).alias("last"))


@query("ring_file_round_trip", f"WITH {BASE} SELECT name AS key, 0 AS tier, 3600 AS step, ts, round(value + 1e-9, 6) AS value FROM pts")
def ring_file_round_trip(spark, sf_dir):
    """Every series as a file of rings, read again."""
    s = hourly(spark, sf_dir)
    return ringfile.decoded(ringfile.encoded(s.catalog, s.points))[1].select("key", "tier", "step", "ts", rounded("value").alias("value"))


@query("pickle_decode", f"WITH {BASE} SELECT key, ts, round(value + 1e-9, 6) AS value FROM e")
def pickle_decode(spark, sf_dir):
    """Every event as a framed pickle, decoded again."""

    def frames(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("key", "ts", "value")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([pickled.encode(list(rows))], pa.binary())], names=["content"])

    blobs = event_points(spark, sf_dir).select("key", "ts", "value").mapInArrow(frames, "content binary")
    return pickled.parse_pickled(blobs).select("key", "ts", rounded("value").alias("value"))


@query("line_decode", f"WITH {BASE} SELECT key, ts, round(value + 1e-9, 6) AS value FROM e")
def line_decode(spark, sf_dir):
    """Every event as a line of text, parsed again."""
    text = F.concat_ws(" ", "key", F.col("value").cast("string"), F.col("ts").cast("string"))
    return lines.parse_lines(event_points(spark, sf_dir).select(text.alias("value")), NOW).select("key", "ts", rounded("value").alias("value"))


# functions that other rows do not show

_C = "events.click.*"
_CLICK = "FROM pts WHERE name LIKE 'events.click.%'"
_add("fn_alias_by_tags", f'aliasByTags({_C},"type",2)', f"SELECT 'click.' || split_part(name, '.', 3) AS name, ts, value {_CLICK}")
_add("fn_alias_query", f'aliasQuery({_C},"click","view","last %d")', f"SELECT coalesce('last ' || trunc(v)::BIGINT, name) AS name, ts, value FROM pts LEFT JOIN (SELECT replace(name, 'view', 'click') AS name, arg_max(value, ts) AS v FROM pts WHERE name LIKE 'events.view.%' GROUP BY 1) USING (name) WHERE name LIKE 'events.click.%'")
_add("fn_aggregate_with_wildcards", f'aggregateWithWildcards({E},"max",2)', "SELECT 'events.' || split_part(name, '.', 2) AS name, ts, max(value) AS value FROM pts GROUP BY 1, 2")
_add("fn_pct", f"pct({T})", "SELECT 'asPercent(' || name || ')' AS name, ts, 100 * value / sum(value) OVER (PARTITION BY ts) AS value FROM t")
_add("fn_map", f"map({_C},0)", f"SELECT name, ts, value {_CLICK}")
for _n, _m, _r in (("fn_map_reduce", "mapSeries", "reduceSeries"), ("fn_reduce", "map", "reduce")):
    _add(_n, f'{_r}({_m}(events.*.*,0),"diffSeries",1,"click","view")', "SELECT 'events.reduce.diffSeries' AS name, ts, 2 * arg_min(value, name) - sum(value) AS value FROM pts WHERE split_part(name, '.', 2) IN ('click', 'view') GROUP BY ts")
_COUNTED = 'groupByNode(events.{}.*,1,"count")'
_add("fn_pow_series", f"powSeries(scale({_COUNTED.format('click')},0.5),scale({_COUNTED.format('view')},0.25))", f"SELECT 'powSeries(scale({_COUNTED.format('click')},0.5),scale({_COUNTED.format('view')},0.25))' AS name, ts, CASE WHEN c > 0 AND v > 0 THEN (0.5 * c) ** (0.25 * v) WHEN c > 0 THEN 0.5 * c ELSE 0.25 * v END AS value FROM (SELECT ts, count(*) FILTER (name LIKE 'events.click.%') AS c, count(*) FILTER (name LIKE 'events.view.%') AS v FROM pts WHERE split_part(name, '.', 2) IN ('click', 'view') GROUP BY ts)")
_add("fn_set_xff", f"sumSeries(setXFilesFactor({_C},0.02))", f"SELECT 'sumSeries(setXFilesFactor({_C},0.02))' AS name, ts, sum(value) AS value {_CLICK} GROUP BY ts HAVING count(*) >= 0.02 * (SELECT count(DISTINCT name) {_CLICK})")
_add("fn_xff_moving", f"movingSum(xFilesFactor({T},0.9),5)", f"SELECT 'movingSum(' || name || ',5)' AS name, ts, CASE WHEN count(value) OVER {PRIOR} >= 0.9 * 5 THEN sum(value) OVER {PRIOR} END AS value FROM d")


def _coarse(target: str, most: int):
    return lambda spark, sf_dir: consolidated(evaluate(hourly(spark, sf_dir), target, START - 1, NOW - 1, NOW, HOUR), most).result().select("name", "ts", rounded("value").alias("value"))


_WIDE = -(-(NOW - START) // HOUR // 100) * HOUR
for _n, _target, _agg in (("fn_consolidate_by", f'consolidateBy({T},"max")', "max(value)"), ("fn_cumulative", f"cumulative({T})", "sum(value)"), ("fn_consolidated", T, "avg(value)")):
    query(_n, _sql(f"SELECT name, {START} + (ts - {START}) // {_WIDE} * {_WIDE} AS ts, {_agg} AS value FROM t GROUP BY 1, 2"))(_coarse(_target, 100))


def _add_options(name: str, target: str, shown: str, options: str) -> None:
    def run(spark, sf_dir):
        s = evaluate(hourly(spark, sf_dir), target, START - 1, NOW - 1, NOW, HOUR)
        pairs = F.transform(F.array_sort(F.map_entries("options")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
        return s.dim.select("name", F.array_join(pairs, ",").alias("options"))

    query(name, f"WITH {BASE} SELECT {shown} AS name, '{options}' AS options FROM (SELECT DISTINCT name {_CLICK})")(run)


for _n, _target, _shown, _kv in (
    ("fn_alpha", f"alpha({_C},0.5)", "name", "alpha=0.5"), ("fn_area_between", f"areaBetween({_C})", "name", "areaBetween=true"), ("fn_color", f'color({_C},"red")', "name", "color=red"),
    ("fn_dashed", f"dashed({_C},3)", "'dashed(' || name || ',3)'", "dashed=3"), ("fn_draw_as_infinite", f"drawAsInfinite({_C})", "'drawAsInfinite(' || name || ')'", "drawAsInfinite=true"),
    ("fn_line_width", f"lineWidth({_C},2)", "name", "lineWidth=2"), ("fn_second_y_axis", f"secondYAxis({_C})", "name", "secondYAxis=true"),
):
    _add_options(_n, _target, _shown, _kv)
query("fn_threshold", _sql("SELECT 'limit' AS name, ts, 7.5 AS value FROM grid"))(lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), 'threshold(7.5,"limit","red")', START, NOW, NOW, HOUR).result())
query("fn_vertical_line", _sql(f"SELECT 'mark' AS name, {START + 7200} AS ts, 1 AS value"))(lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), f'verticalLine({START + 7200},"mark")', START, NOW, NOW, HOUR).result())

# recursive smoothing

ORACLE_SQL["fn_ema"] = _sql("""WITH RECURSIVE r AS (
SELECT name, 9::BIGINT AS i, avg(value) AS state FROM d WHERE i < 10 GROUP BY name
UNION ALL SELECT r.name, r.i + 1, CASE WHEN d.value IS NULL THEN r.state WHEN r.state IS NULL THEN d.value ELSE 2.0 / 11 * d.value + (1 - 2.0 / 11) * r.state END FROM r JOIN d ON d.name = r.name AND d.i = r.i + 1)
SELECT 'exponentialMovingAverage(' || d.name || ',10)' AS name, ts, state AS value FROM r JOIN d ON d.name = r.name AND d.i = r.i WHERE d.value IS NOT NULL OR r.i = 9""")
#: The level begins at the first value; hours of a day are places 1 to 24 of the two lists.
_HW = """WITH RECURSIVE hw AS (
SELECT DISTINCT name, -1::BIGINT AS i, NULL::DOUBLE AS level, 0.0::DOUBLE AS trend, [0.0::DOUBLE for x in range(24)] AS cycle, [0.0::DOUBLE for x in range(24)] AS spread, NULL::DOUBLE AS forecast, 0.0::DOUBLE AS deviation FROM d
UNION ALL SELECT name, i, l2 AS level, CASE WHEN level IS NULL OR y IS NULL THEN trend ELSE 0.0035 * (l2 - level) + 0.9965 * trend END,
CASE WHEN level IS NULL OR y IS NULL THEN cycle ELSE list_concat(list_concat(cycle[1:k], [0.1 * (y - l2) + 0.9 * cycle[k + 1]]), cycle[k + 2:24]) END,
CASE WHEN level IS NULL OR y IS NULL THEN spread ELSE list_concat(list_concat(spread[1:k], [0.1 * abs(y - f) + 0.9 * spread[k + 1]]), spread[k + 2:24]) END, f, CASE WHEN level IS NULL THEN 0.0 ELSE spread[k + 1] END
FROM (SELECT *, CASE WHEN level IS NULL THEN y WHEN y IS NULL THEN level + trend ELSE 0.1 * (y - cycle[k + 1]) + 0.9 * (level + trend) END AS l2, level + trend + cycle[k + 1] AS f
FROM (SELECT hw.name, hw.i + 1 AS i, (hw.i + 1) % 24 AS k, d.value AS y, level, trend, cycle, spread FROM hw JOIN d ON d.name = hw.name AND d.i = hw.i + 1))),
h AS (SELECT hw.name, d.ts, d.value AS y, forecast AS f, 3 * deviation AS w FROM hw JOIN d ON d.name = hw.name AND d.i = hw.i WHERE forecast IS NOT NULL)
"""
_BANDS = "SELECT 'holtWintersConfidenceLower(' || name || ')' AS name, ts, f - w AS value FROM h UNION ALL SELECT 'holtWintersConfidenceUpper(' || name || ')', ts, f + w FROM h"
ORACLE_SQL["fn_holt_winters_forecast"] = _sql(_HW + "SELECT 'holtWintersForecast(' || name || ')' AS name, ts, f AS value FROM h")
ORACLE_SQL["fn_holt_winters_bands"] = ORACLE_SQL["fn_holt_winters_area"] = _sql(_HW + _BANDS)
ORACLE_SQL["fn_holt_winters_aberration"] = _sql(_HW + "SELECT 'holtWintersAberration(' || name || ')' AS name, ts, CASE WHEN y > f + w THEN y - f - w WHEN y < f - w THEN y - f + w WHEN y IS NOT NULL THEN 0 END AS value FROM h")
