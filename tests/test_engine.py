import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalogue, glob, smoothing, timeparse
from tidemark.operators import catalog as cat
from tidemark.operators import ingest, read, stores, tables
from tidemark.plans import frame
from tidemark.plans.evaluate import evaluate, render
from tidemark.plans.language import Call, Const, QueryError, Ref, parse, references
from tidemark.sources import lines, pickled, render as sinks, ringfile

T = 1_700_000_000
W = "60:129600,3600:87600"
B = "60:43200,3600:8760"

GLOBS = [
    ("test.key1", "test.key1", True), ("test.key2", "test.key1", False), ("test.dir1.key1", "test.*.key1", True), ("test.dir1.key1", "test.dir*.key1", True),
    ("test.dir1.key1", "test.*1.key1", True), ("test.dir1.key1", "*.key1", False), ("test.dir1.key1", "test.*", False), ("test.dir1.key1", "*.dir1.key1", True),
    ("test.dir1.key1", "test.dir1.*", True), ("test.dir1.key1", "**", True), ("test.dir1.key1", "**.key1", True), ("test.dir1.key1", "test.**", True),
    ("test.dir1.key1", "**.dir1.key1", True), ("test.dir1.key1", "test.**.key1", True), ("test.dir1.key1", "test.dir1.**", True), ("test.dir1.key1", "test.dir**.key1", True),
    ("test.dir1.key1", "test.**1.key1", True), ("test.dir1.key1", "test.dir[123].key1", True), ("test.dir1.key1", "test.dir[234].key1", False), ("test.dir1.key1", "test.dir[123].key[135]", True),
    ("test.dir1.key1", "test.dir[123].key[357]", False), ("test.dir1.key1", "test.{dir1,dir2}.key1", True), ("test.dir1.key1", "test.{dir0,dir2}.key1", False),
    ("test.dir1.key1", "test.*{r1,r2}.key1", True), ("test.dir1.key1", "test.*{r2,r3}.key1", False), ("test.dir1.key1", "test.*[123].key1", True), ("test.dir1.key1", "test.*[345].key1", False),
    ("test.dir1.key1", "test.dir*.{ke,bu}y[123]", True), ("test.dir1.key1", "test.dir*.{gu,bu}y[123]", False), ("test.dir1.key1", "test.diz*.{ke,bu}y[123]", False),
    ("key", "key*", False), ("abc", "a*bc", True), ("abc", "{a,ab}bc", False), ("name", "{dir,}name", False), ("b", "[a-c]", False), ("ab", "a*b*", False),
]


@pytest.mark.parametrize("name,pattern,want", GLOBS)
def test_glob(name, pattern, want):
    assert glob.matches(name, pattern) is want


def test_glob_in_spark_equals_python(spark):
    df = spark.createDataFrame([(n,) for n in {g[0] for g in GLOBS}], "name string")
    for pattern in {g[1] for g in GLOBS}:
        got = {r.name for r in df.where(glob.condition(F.col("name"), pattern)).collect()}
        assert got == {n for n in {g[0] for g in GLOBS} if glob.matches(n, pattern)}


def test_glob_errors_and_options():
    for p in ("{a", "[a"):
        with pytest.raises(glob.PatternError):
            glob.regex(p)
    assert glob.matches("name", "{dir,}name", empty_alternatives=True)
    assert glob.is_pattern("a{b}") and not glob.is_pattern("a.b")
    assert glob.is_basename("a*") and not glob.is_basename("a.b") and not glob.is_basename("**")
    assert glob.is_valid_key("a.b-c:@#=_1") and not any(map(glob.is_valid_key, ("", ".a", "a.", "a..b", "a b", "a*")))


def test_times():
    assert [timeparse.duration(x) for x in ("90d", "-2h", "5", "1y", "10min")] == [7776000, -7200, 5, 31536000, 600]
    assert timeparse.duration("5", 60) == 300
    assert [timeparse.relative_time(x, 1000) for x in ("now", "-1h", "+2m", "010", "0x10", "77")] == [1000, -2600, 1120, 8, 16, 77]
    assert timeparse.archives("60:90d,1h:87600") == [(60, 129600), (3600, 87600)]
    for bad in ("", "0:5", "60:100,60:200", "3600:10,60:10", "60:100,90:1000", "60:100,120:50", "60:5,3600:10"):
        with pytest.raises(ValueError):
            timeparse.archives(bad)


def test_parser():
    assert parse("a.b.c") == Ref("a.b.c")
    q = parse("sumSeries(a.{b,c}.d, avg(x.*))")
    assert q == Call("sumSeries", (Ref("a.{b,c}.d"), Call("avg", (Ref("x.*"),)))) and references(q) == {"a.{b,c}.d", "x.*"}
    assert [a.value for a in parse("scale(a.b,-1e3)").args[1:]] == [-1000.0]
    assert isinstance(parse("f(2)").args[0], Const) and parse("f(2)").args[0].value == 2
    assert [a.value for a in parse("f(\"x y\",'z')").args] == ["x y", "z"]
    for bad in ("sum()", '"abc', "a}", "*.cpu", "_x", "sum(a)b", "", "f(1.2.3)", "sum(a", "a{b"):
        with pytest.raises(QueryError):
            parse(bad)


def store(spark, keys, archives=W, method=1, xff=0.5, rules=()):
    s = stores.Store.empty(spark, list(rules))
    if keys:
        c = spark.createDataFrame([(k,) for k in keys], "key string").select("key", ingest.archives_column(archives).alias("archives"), F.lit(xff).alias("xff"), F.lit(method).alias("agg"))
        s.update_metadata(c)
    return s


def batch(spark, rows):
    return spark.createDataFrame([(k, t, float(v), i) for i, (k, t, v) in enumerate(rows)], "key string, ts bigint, value double, arrival bigint")


def data(s, pattern, start, end, now):
    return sorted((r.name, r.ts, r.value) for r in s.read([pattern], start, end, now)[1].collect())


def test_single_point_and_window(spark):
    s = store(spark, ["a.b"])
    assert [(r.key, r.error) for r in s.write(batch(spark, [("a.b", T, 1)]), T).collect()] == [("a.b", "")]
    head, rows = s.read(["a.b"], T - 600, T, T)
    h = head.first()
    assert (h.step, h.start_time, h.end_time) == (60, (T // 60 - 9) * 60, (T // 60 + 1) * 60)
    assert [(r.ts, r.value) for r in rows.collect()] == [(T // 60 * 60, 1.0)]


def test_history_of_ninety_points(spark):
    s = store(spark, ["a.b"])
    s.write(batch(spark, [("a.b", T - 60 * x, x) for x in range(90)]), T)
    got = data(s, "a.b", T - 6000, T + 60, T)
    assert [(t, v) for _, t, v in got] == [((T - 60 * x) // 60 * 60, float(x)) for x in reversed(range(90))]


def test_missing_and_invalid(spark):
    s = store(spark, ["a.b"])
    assert data(s, "a.none", T - 600, T, T) == []
    h = s.read(["a.none"], T - 600, T, T)[0].first()
    assert (h.step, h.start_time, h.end_time) == (0, T - 600, T)
    got = {r.key: (r.error, r.ignored) for r in s.write(batch(spark, [("no.such", T, 1), ("bad key", T, 1), ("a.b", T, 1)]), T).collect()}
    assert got == {"no.such": ("series does not exist", False), "bad key": ("key contains invalid characters", True), "a.b": ("", False)}
    with pytest.raises(read.RangeError):
        s.read(["a.b"], T, T - 1, T)


def test_same_slot_is_empty_window(spark):
    s = store(spark, ["a.b"])
    s.write(batch(spark, [("a.b", T, 1)]), T)
    assert data(s, "a.b", T, T, T) == []


def test_autocreate(spark):
    s = store(spark, [], rules=[("t.auto.**", B, 0.0, "average"), ("t.**", "300:30d", 0.5, "max")])
    s.write(batch(spark, [("t.auto.x.y", T, 2), ("t.other", T, 3), ("u.v", T, 1)]), T)
    got = {r.key: ([(a.precision, a.points) for a in r.archives], r.xff, r.agg) for r in s.catalog.collect()}
    assert got == {"t.auto.x.y": ([(60, 43200), (3600, 8760)], 0.0, 1), "t.other": ([(300, 8640)], 0.5, 5)}
    meta, points = s.read_all("t.auto.x.y")
    assert meta.count() == 1 and sorted(r.tier for r in points.collect()) == [0, 1]


def rings(archives, method, xff, calls, now):
    """A plain model of the tiers: dicts of slots, written call by call."""
    a = timeparse.archives(archives)
    tiers = [{} for _ in a]
    for points in calls:
        touched = [set() for _ in a]
        best = {}
        for i, (ts, v) in enumerate(points):
            k = next((k for k, (s, n) in enumerate(a) if s * n >= now - ts), None)
            if k is None:
                continue
            slot = ts - ts % a[k][0]
            rank = (ts, -i)
            if (k, slot) not in best or rank < best[k, slot][0]:
                best[k, slot] = (rank, v)
        for (k, slot), (_, v) in best.items():
            tiers[k][slot] = v
            touched[k].add(slot)
        direct = set(best)
        done = set()
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                ok = False
                for lo in sorted({s - s % a[j][0] for s in touched[i]}):
                    own = sorted((s, v) for s, v in tiers[i].items() if lo <= s < lo + a[j][0])
                    if len(own) < xff * (a[j][0] / a[i][0]):
                        continue
                    ok = True
                    vs = [v for _, v in own]
                    real = [v for v in vs if v is not None and not math.isnan(v)]
                    value = {1: lambda: sum(vs) / len(vs), 2: lambda: sum(vs), 3: lambda: vs[-1], 4: lambda: min(real) if real else None, 5: lambda: max(real) if real else None}[method]()
                    if (j, lo) not in direct and (j, lo) not in done:
                        tiers[j][lo] = value
                        done.add((j, lo))
                if touched[i] and not ok:
                    break
    return {(k, t): v for k, d in enumerate(tiers) for t, v in d.items()}


@pytest.mark.parametrize("method,xff", [(1, 0.0), (2, 0.1), (3, 0.5), (4, 0.0), (5, 0.02)])
def test_rollup_equals_model(spark, method, xff):
    rnd = random.Random(method)
    archives = "60:120,300:100,1800:200"
    s = store(spark, ["k"], archives, method, xff)
    calls = [[(T - rnd.choice([rnd.randrange(7000), rnd.randrange(30000), rnd.randrange(400000)]), float(rnd.randrange(100)) if rnd.random() > 0.05 else math.nan) for _ in range(60)] for _ in range(2)]
    for c in calls:
        s.write(batch(spark, [("k", t, v) for t, v in c]), T)
        s.points = spark.createDataFrame(s.points.collect(), cat.POINTS)
    got = {(r.tier, r.ts): r.value for r in s.points.collect()}
    want = rings(archives, method, xff, calls, T)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, nan_ok=True)), k


def test_slot_conflict_order(spark):
    for conflict, want in (("oldest", 1.0), ("latest", 2.0)):
        s = store(spark, ["k"], "60:1000")
        s.conflict = conflict
        s.write(batch(spark, [("k", T - T % 60 + 5, 1), ("k", T - T % 60 + 9, 2), ("k", T - T % 60 + 5, 1)]), T)
        assert [r.value for r in s.points.collect()] == [want]


def test_find_delete_rename_update(spark):
    keys = ["test.DiskStore.key1", "test.key2", "test.auto.d1.d2.d3.key1"]
    s = store(spark, keys, B)
    found = lambda *p: sorted(r.name for r in s.find(list(p))[0].collect())
    assert found("test.*") == ["test.DiskStore.*", "test.auto.*", "test.key2"]
    assert found("test.DiskStore.*") == ["test.DiskStore.key1"] and found("test.No*") == [] and found("test.DiskStore.no*") == []
    assert found("test.**") == sorted(keys) and found("test.nothing.**") == [] and found("test.DiskStore") == ["test.DiskStore.*"]
    assert [r.error != "" for r in s.find(["a.**.b"])[1].collect()] == [True]
    r = {x.key: (x.error, x.ignored) for x in s.rename_series([("test.key2", "test.auto.d1.d2.d3.key1"), ("no.key", "x"), ("test.DiskStore.key1", "test.moved")]).collect()}
    assert r == {"test.key2": ("destination exists", True), "no.key": ("series does not exist", False), "test.DiskStore.key1": ("", False)}
    assert found("test.**") == ["test.auto.d1.d2.d3.key1", "test.key2", "test.moved"]
    assert {x.pattern: x.deleted for x in s.delete_series(["test.*", "none.**"]).collect()} == {"test.*": 2, "none.**": 0}
    assert found("test.**") == ["test.auto.d1.d2.d3.key1"]
    c = s.catalog
    assert [(x.error, x.ignored) for x in s.update_metadata(c, cat.IGNORE).collect()] == [("series already exists", True)]


def test_rename_merge_three_points(spark):
    s = store(spark, ["k1", "k2"], B)
    s.write(batch(spark, [("k1", T, 2), ("k1", T - 60, 3), ("k2", T - 60, 1), ("k2", T - 120, 0)]), T)
    s.rename_series([("k1", "r")])
    s.rename_series([("r", "k2")], merge=True, now=T)
    f = lambda t: t // 60 * 60
    assert [(t, v) for _, t, v in data(s, "k2", T - 3600, T, T)] == [(f(T - 120), 0.0), (f(T - 60), 3.0), (f(T), 2.0)]
    assert [r.key for r in s.catalog.collect()] == ["k2"]


def test_resample_and_recreate(spark):
    s = store(spark, ["k"], B)
    s.write(batch(spark, [("k", T - x, x) for x in range(0, 86400, 300)]), T)
    new = spark.createDataFrame([("k",)], "key string").select("key", ingest.archives_column("300:8640,3600:8760").alias("archives"), F.lit(1.0).alias("xff"), F.lit(1).alias("agg"))
    s.update_metadata(new, cat.UPDATE, now=T)
    got = data(s, "k", T - 86400, T, T)
    assert len(got) == 288 and {t % 300 for _, t, _ in got} == {0} and sorted(v for *_, v in got) == [float(x) for x in range(0, 86400, 300)]
    s.update_metadata(new, cat.RECREATE)
    assert s.points.count() == 0


def test_read_only_empty_and_multi(spark):
    base = store(spark, ["a.b"], "60:1000")
    ro = stores.ReadOnlyStore(base.catalog, base.points)
    assert [r.error for r in ro.write(batch(spark, [("a.b", T, 1)]), T).collect()] == [stores.NOT_ALLOWED]
    empty = stores.EmptyStore.empty(spark)
    assert [r.error for r in empty.write(batch(spark, [("a.b", T, 1)]), T).collect()] == [""] and empty.points.count() == 0
    m = stores.MultiStore([store(spark, ["a.b"], "60:1000"), store(spark, ["a.b"], "60:1000")])
    m.write(batch(spark, [("a.b", T, 1)]), T)
    head, rows = m.read(["a.b"], T - 60, T, T)
    assert head.first().error == "" and rows.count() == 2
    assert m.read_series("a.b", T - 60, T, T).pts.count() == 1
    m.stores[1].catalog = m.stores[1].catalog.withColumn("archives", ingest.archives_column("300:1000"))
    assert m.read(["a.b"], T - 60, T, T)[0].first().error == "merged results with different schemas"
    r = lambda e, i: spark.createDataFrame([("k", e, i)], cat.RESULT)
    assert stores.combined_results([r("x", True), r("", False)]).first().error == ""
    assert stores.combined_results([r("x", True), r("", False), r("bad", False)]).first().error == "bad"


def test_ring_placement(spark):
    ring = stores.ring([("h1", "a"), ("h2", "b")], 10)
    import bisect
    import hashlib

    keys = [f"k{i}.x" for i in range(200)]
    got = {r.key: r.store for r in stores.place_keys(spark.createDataFrame([(k,) for k in keys], "key string"), ring).collect()}
    for k in keys:
        at = int(hashlib.md5(k.encode()).hexdigest()[:4], 16)
        i = bisect.bisect_left([p for p, _ in ring], at)
        assert got[k] == ring[i % len(ring)][1]
    actual = spark.createDataFrame([(k, 0) for k in keys], "key string, store int")
    assert {r.key for r in stores.verify(actual, ring).collect()} == {k for k in keys if got[k]}


def test_tables_versions_and_compaction(spark, tmp_path):
    s = store(spark, ["a.b", "c"], "60:10,600:100", xff=0.0)
    s.write(batch(spark, [("a.b", T, 1), ("c", T - 60, 2)]), T)
    p = str(tmp_path / "store")
    assert tables.version(spark, p) == 0 and tables.load(spark, p).points.count() == 0
    assert tables.save(s, p) == 1
    back = tables.load(spark, p)
    assert sorted(map(tuple, back.points.collect())) == sorted(map(tuple, s.points.collect()))
    assert tables.save(back, p) == 2
    assert {r.tier for r in tables.compact(back, T + 3600).points.collect()} == {1}


def test_sources(spark):
    text = spark.createDataFrame([("a.b 1.5 100",), ("a.b 2",), ("a.b 2 0",), ("c -3 -1h",), ("bad",), ("a b c d",), ("a x 1",), ("a 1 zzz",)], "value string")
    got = sorted((r.key, r.ts, r.value) for r in lines.parse_lines(text, T).collect())
    assert got == [("a.b", 100, 1.5), ("a.b", T, 2.0), ("a.b", T, 2.0), ("c", T - 3600, -3.0)]
    grams = spark.createDataFrame([("a 1 5\nb 2 6\n",)], "value string")
    assert sorted((r.key, r.ts) for r in lines.parse_datagrams(grams, T).collect()) == [("a", 5), ("b", 6)]
    import pickle
    import struct

    evil = pickle.dumps([print])
    blob = pickled.encode([("a", 1, 2.0), ("b", 3, 4.5)]) + struct.pack(">I", len(evil)) + evil + pickled.encode([("c", 5, 6.0)]) + b"\0\0\0\xffshort"
    got = [(r.key, r.ts, r.value) for r in pickled.parse_pickled(spark.createDataFrame([(bytearray(blob),), (None,)], "content binary")).collect()]
    assert got == [("a", 1, 2.0), ("b", 3, 4.5), ("c", 5, 6.0)]


def test_ring_files(spark, tmp_path):
    d = tmp_path / "x" / "a"
    d.mkdir(parents=True)
    (d / "b.wsp").write_bytes(ringfile.encode([(60, 10), (600, 20)], 2, 0.5, [[(T, 1.0), (T + 60, 2.0), (T + 120, math.nan)], [(T, 3.0)]]))
    (d / "bad.wsp").write_bytes(b"junk")
    catalog, points = ringfile.scan(spark, str(tmp_path / "x"))
    c = catalog.first()
    assert (c.key, [(a.precision, a.points) for a in c.archives], c.xff, c.agg) == ("a.b", [(60, 10), (600, 20)], 0.5, 2) and catalog.count() == 1
    assert sorted((r.tier, r.ts, r.value) for r in points.collect()) == [(0, T - T % 60, 1.0), (0, T + 60 - T % 60, 2.0), (1, T - T % 600, 3.0)]


@pytest.fixture(scope="module")
def small(spark):
    s = store(spark, ["a.x.one", "a.y.one", "a.x.two"], "60:1000")
    t0 = T - T % 60
    rows = [("a.x.one", t0 - 60 * i, v) for i, v in enumerate([1, 2, 3, 4])] + [("a.y.one", t0 - 60 * i, v) for i, v in enumerate([10, 20])] + [("a.x.two", t0 - 180, 5)]
    s.write(batch(spark, rows), T)
    s.points = spark.createDataFrame(s.points.collect(), cat.POINTS)
    s.catalog = spark.createDataFrame(s.catalog.collect(), cat.CATALOG)
    return s


def run(s, target, start=-240):
    t0 = T - T % 60
    out = {}
    for r in evaluate(s, target, t0 + start - 1, T, T).result().collect():
        out.setdefault(r.name, {})[(r.ts - t0) // 60] = r.value
    return out


def test_registered_functions(small):
    assert run(small, "sumSeries(a.*.*)") == {"sumSeries(a.*.*)": {0: 11.0, -1: 22.0, -2: 3.0, -3: 9.0}}
    assert run(small, "avg(a.x.*,a.x.one)") == {"averageSeries(a.x.*,a.x.one)": {0: 1.0, -1: 2.0, -2: 3.0, -3: 13 / 3}}
    assert run(small, "scale(a.y.one,0.5)") == {"a.y.one": {0: 5.0, -1: 10.0}}
    for bad in ("nosuch(a.x.one)", "scale(a.x.one)", "3", "sum(a.x.one,3)"):
        with pytest.raises(QueryError):
            run(small, bad)


def test_errors_do_not_stop_other_targets(small):
    rows, errors = render(small, ["sum(a.x.*)", "bad(("], T - 600, T, T)
    e = {r.query: r.error for r in errors.collect()}
    assert e["sum(a.x.*)"] == "" and e["bad(("] and {r.query for r in rows.collect()} == {"sum(a.x.*)"}


def test_interpolation_limits(small):
    assert run(small, "keepLastValue(a.x.two,3)")["keepLastValue(a.x.two)"] == {-3: 5.0, -2: 5.0, -1: 5.0, 0: 5.0}
    assert run(small, "keepLastValue(a.x.two,2)")["keepLastValue(a.x.two)"] == {-3: 5.0}
    assert run(small, "transformNull(a.y.one,0,a.x.one)")["transformNull(a.y.one,0)"] == {0: 10.0, -1: 20.0, -2: 0.0, -3: 0.0}


def test_missing_totals(small):
    got = run(small, "asPercent(a.x.one,group(a.y.one,a.x.two),1)")
    assert got == {"asPercent(a.x.one,a.x.two)": {-3: 80.0}}
    names = {r.name for r in evaluate(small, "asPercent(a.x.one,group(a.y.one,a.x.two),1)", T - 600, T, T).dim.collect()}
    assert names == {"asPercent(a.x.one,a.x.two)", "asPercent(MISSING,a.y.one)"}


def test_reduce_and_pow(small):
    got = run(small, 'reduceSeries(mapSeries(a.x.*,1),"diffSeries",2,"one","two")')
    assert got == {"a.x.reduce.diffSeries": {0: 1.0, -1: 2.0, -2: 3.0, -3: -1.0}}
    assert run(small, "powSeries(a.x.one,a.y.one)") == {"powSeries(a.x.one,a.y.one)": {0: 1.0, -1: 2.0**20, -2: 3.0, -3: 4.0}}


def test_hints_and_lines(small):
    s = evaluate(small, 'color(alpha(a.x.one,0.5),"red")', T - 600, T, T)
    assert s.dim.first().options == {"alpha": "0.5", "color": "red"}
    assert set(run(small, "threshold(5)")["5"].values()) == {5.0}
    with pytest.raises(QueryError):
        run(small, "verticalLine(5)")
    assert set(run(small, "holtWintersConfidenceBands(a.x.one)")) <= {"holtWintersConfidenceLower(a.x.one)", "holtWintersConfidenceUpper(a.x.one)"}


#: Every name of the function catalogue (fixed values).
NAMES = """alias aliasByMetric aliasByNode aliasByTags aliasQuery aliasSub legendValue aggregateLine exponentialMovingAverage holtWintersAberration
holtWintersConfidenceArea holtWintersConfidenceBands holtWintersForecast identity linearRegression movingAverage movingMax movingMedian movingMin movingSum
movingWindow nPercentile stdev aggregate aggregateWithWildcards applyByNode asPercent averageSeriesWithWildcards countSeries diffSeries divideSeries
divideSeriesLists group groupByNode groupByNodes groupByTags isNonNull map mapSeries maxSeries minSeries multiplySeries multiplySeriesWithWildcards pct
percentileOfSeries rangeOfSeries reduce reduceSeries stddevSeries sum sumSeries sumSeriesWithWildcards weightedAverage removeAbovePercentile removeAboveValue
removeBelowPercentile removeBelowValue averageAbove averageBelow averageOutsidePercentile currentAbove currentBelow exclude filterSeries grep highest
highestAverage highestCurrent highestMax limit lowest lowestAverage lowestCurrent maximumAbove maximumBelow minimumAbove minimumBelow mostDeviant
removeBetweenPercentile removeEmptySeries unique useSeriesAbove alpha areaBetween color dashed drawAsInfinite lineWidth secondYAxis stacked threshold
verticalLine sortBy sortByMaxima sortByMinima sortByName sortByTotal cactiStyle changed consolidateBy constantLine cumulative events fallbackSeries
seriesByTag setXFilesFactor substr xFilesFactor absolute delay derivative hitcount integral integralByInterval interpolate invert keepLastValue log minMax
nonNegativeDerivative offset offsetToZero perSecond pow powSeries round scaleToSeconds smartSummarize squareRoot summarize timeShift timeSlice timeStack
transformNull avg avgSeries scale""".split()


def test_catalogue_is_complete():
    assert len(set(NAMES)) == 137 and not set(NAMES) - set(catalogue.REGISTRY)


def test_smoothing():
    import numpy as np

    assert smoothing.ema(np.array([1.0, 2, 3, 4]), 2).tolist()[1:] == [1.5, pytest.approx(2.5), pytest.approx(3.5)]
    f, d = smoothing.seasonal(np.array([5.0] * 20), 4)
    assert np.isnan(f[0]) and np.allclose(f[1:], 5) and np.allclose(d, 0)


def test_sinks(small):
    s = small.read_series("a.y.one", T - 600, T, T)
    t0 = T - T % 60
    assert sinks.json_document(s) == f'[{{"target":"a.y.one","datapoints":[[20,{t0 - 60}],[10,{t0}]]}}]'
    found = small.find(["a.*"])[0]
    assert sinks.json_find(found) == '{"a.*": ["a.x.*", "a.y.*"]}'
    assert '"expandable": 1' in sinks.graphite_find(found) and "a.x.*" in sinks.html_find(found)
    import pickle

    (d,) = pickle.loads(sinks.pickle_document(s, "a.y.one"))
    assert d["values"][-2:] == [20.0, 10.0] and d["values"][0] is None and len(d["values"]) == (d["end"] - d["start"]) // d["step"]
    assert {r.key for r in sinks.stat_points(small.stats(), "my.host", T).collect()} == {"tidemark.my_host.series", "tidemark.my_host.points.tier0"}


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import ingest as live

    src = tmp_path / "in"
    src.mkdir()
    rnd = random.Random(3)
    files = [[f"k{rnd.randrange(3)} {rnd.randrange(50)} {T - rnd.randrange(4000)}" for _ in range(40)] for _ in range(3)]
    rules = [("**", "60:200,600:100", 0.0, "sum")]
    s = store(spark, [], rules=rules)
    for i, f in enumerate(files):
        (src / f"{i}.txt").write_text("\n".join(f) + "\n")
        q = live.start(live.points_of(live.line_stream(spark, str(src)), T), str(tmp_path / "store"), str(tmp_path / "ckpt"), rules, T)
        q.awaitTermination(120)
        s.write(lines.parse_lines(spark.createDataFrame([(x,) for x in f], "value string").coalesce(1), T), T)
        s.points = spark.createDataFrame(s.points.collect(), cat.POINTS)
        s.catalog = spark.createDataFrame(s.catalog.collect(), cat.CATALOG)
    got = tables.load(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, got.points.collect())) == sorted(map(tuple, s.points.collect()))


def test_every_registered_query_has_its_sql():
    from tidemark.plans import queries

    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_options_act(small):
    t0 = T - T % 60
    assert run(small, "sumSeries(setXFilesFactor(a.*.*,0.6))") == {"sumSeries(setXFilesFactor(a.*.*,0.6))": {0: 11.0, -1: 22.0, -3: 9.0}}
    assert run(small, "sumSeries(a.*.*)")["sumSeries(a.*.*)"][-2] == 3.0
    assert run(small, "movingSum(xFilesFactor(a.x.one,1),2)") == {"movingSum(a.x.one,2)": {-1: 7.0, 0: 5.0}}
    for target, want in (("a.x.one", [3.5, 1.5]), ('consolidateBy(a.x.one,"max")', [4.0, 2.0]), ("cumulative(a.x.one)", [7.0, 3.0]), ("xFilesFactor(a.x.*,0.6)", [3.5, 1.5])):
        rows = render(small, [target], t0 - 241, t0 - 1 + 60, T, most=2)[0].collect()
        assert sorted((r.value for r in rows if r.name == "a.x.one"), reverse=True) == want
    assert run(small, 'timeShift(a.x.one,"1min")') == {"timeShift(a.x.one,'1min')": {0: 2.0, -1: 3.0, -2: 4.0}}
    assert run(small, 'timeShift(a.x.one,"1min",False)') == {"timeShift(a.x.one,'1min')": {1: 1.0, 0: 2.0, -1: 3.0, -2: 4.0}}


def test_daylight_saving():
    from types import SimpleNamespace

    zone = SimpleNamespace(spark=SimpleNamespace(conf={"spark.sql.session.timeZone": "Europe/Berlin"}))
    summer, winter = 1_688_000_000, 1_673_000_000
    zone.start, zone.end = summer, summer + 60
    assert catalogue._saving(zone, winter, winter + 60) == 3600 and catalogue._saving(zone, summer - 60, summer) == 0
    zone.start, zone.end = winter, winter + 60
    assert catalogue._saving(zone, summer, summer + 60) == -3600


@pytest.mark.parametrize("name", ["overlay_read", "resample_update", "rename_merge", "buffer_flush", "routed_read"])
def test_store_queries_over_all_events_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
    got = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
    key = 1 if name in ("overlay_read", "routed_read") else 0
    assert got == want and len({r[key].split(".")[1] for r in got}) > 1


def test_write_deals_rows_out_between_its_steps(spark):
    """A task that placed, rolled up and laid over at once held the sorts of all steps."""
    s = stores.Store.empty(spark, [("**", W, 0.0, "sum")])
    s.write(spark.createDataFrame([("a.b", T, 1.0)], "key string, ts bigint, value double"), T)
    plan = s.points._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key#" in plan and plan.count("RepartitionByExpression") >= 3
    assert {(r.tier, r.value) for r in s.points.collect()} == {(0, 1.0), (1, 1.0)}


def test_files_and_frames_go_to_python_in_bounded_batches(spark):
    rows = [(f"a.k{i}", T - T % 60, float(i)) for i in range(600)]
    blobs = spark.createDataFrame([(pickled.encode(rows[:300]) + pickled.encode(rows[300:]),)], "content binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    out = pickled.parse_pickled(blobs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert {tuple(r) for r in out.collect()} == set(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog = spark.createDataFrame([(k, [(60, 1440)], 0.0, 2) for k, _, _ in rows], cat.CATALOG)
    points = spark.createDataFrame([(k, 0, 60, t, v) for k, t, v in rows], cat.POINTS)
    found, back = ringfile.decoded(ringfile.encoded(catalog, points))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert {(r.key, r.ts, r.value) for r in back.collect()} == set(rows) and found.count() == 600


def test_filters_do_not_see_the_order_of_adding(spark):
    """0.1 + 0.2 + 0.3 is 0.6000000000000001 or 0.6; their average is 0.2 and not above it."""
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sid bigint, name string").withColumns({"start_time": F.lit(0), "end_time": F.lit(3), "step": F.lit(1)})
    pts = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.1, 0.2, 0.3))] + [(2, 0, 0.2000001), (3, 0, float("inf"))], "sid bigint, ts bigint, value double")
    s = frame.Series(frame.shaped(dim), pts)
    got = {op: {r.name for r in catalogue._filtered(s, "average", op, 0.2).dim.collect()} for op in (">", ">=", "=", "<")}
    assert got == {">": {"b", "c"}, ">=": {"a", "b", "c"}, "=": {"a"}, "<": set()}
    assert {r.name for r in catalogue._filtered(s, "sum", "=", 0.6).dim.collect()} == {"a"}
