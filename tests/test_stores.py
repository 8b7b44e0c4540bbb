"""Stores made of stores, the write buffer, commits and text requests."""

import pickle

import pytest
from pyspark.sql import functions as F

from tidemark.operators import buffer, ingest, stores, tables
from tidemark.operators import catalog as cat
from tidemark.plans import requests
from tidemark.plans.evaluate import evaluate

T = 1_700_000_040  # a whole minute
S = "60:1000"


def changes(spark, keys, archives=S, xff=0.0, agg=2):
    return spark.createDataFrame([(k,) for k in keys], "key string").select("key", ingest.archives_column(archives).alias("archives"), F.lit(xff).alias("xff"), F.lit(agg).alias("agg"))


def batch(spark, rows):
    return spark.createDataFrame([(k, t, float(v), i) for i, (k, t, v) in enumerate(rows)], "key string, ts bigint, value double, arrival bigint")


def plain(spark):
    return stores.Store.empty(spark)


def ringed(spark):
    places = [("10.0.0.1", "a"), ("10.0.0.2", "b")]
    return stores.RingStore([plain(spark) for _ in places], places=places)


def stacks(spark):
    return {
        "one": lambda: plain(spark),
        "buffer": lambda: buffer.BufferedStore(plain(spark)),
        "multi": lambda: stores.MultiStore([plain(spark), plain(spark)]),
        "ring": lambda: ringed(spark),
    }


def values(store, pattern, start=T - 3600, end=T):
    return {(r.name, r.ts): r.value for r in store.read([pattern], start, end, T)[1].collect()}


@pytest.mark.parametrize("stack", ["one", "buffer", "multi", "ring"])
def test_scenario(spark, stack):
    """The same calls on every kind of store."""
    s = stacks(spark)[stack]()
    s.update_metadata(changes(spark, ["a.b", "a.c"]), create_new=True)
    if stack == "buffer":
        assert {r.name for r in s.find(["a.*"])[0].collect()} == {"a.b", "a.c"}
        s.flush(T)
    s.write(batch(spark, [("a.b", T, 1), ("a.c", T - 60, 2), ("a.c", T - 5, 3)]), T)
    want = {("a.b", T): 1.0, ("a.c", T - 60): 2.0 if stack != "buffer" else 3.0}
    got = values(s, "a.*")
    assert got == ({("a.b", T): 1.0, ("a.c", T - 60): 3.0} if stack == "buffer" else want)  # a buffer shows the newest second of a slot
    if stack == "buffer":
        s.flush(T)
        assert values(s, "a.*") == {("a.b", T): 1.0, ("a.c", T - 60): 2.0}
    assert {(r.name, r.is_directory) for r in s.find(["*", "a.*"])[0].collect()} == {("a.*", True), ("a.b", False), ("a.c", False)}
    out = {r.key: r.error for r in s.rename_series([("a.b", "x.y"), ("none", "x.z")], now=T).collect()}
    assert out == {"a.b": "", "none": "series does not exist"}
    assert values(s, "x.y") == {("x.y", T): 1.0}
    s.rename_series([("x.y", "a.c")], merge=True, now=T)
    assert values(s, "a.**") == {("a.c", T): 1.0, ("a.c", T - 60): 2.0}
    got = {r.pattern: r.deleted for r in s.delete_series(["a.*"]).collect()}
    assert got == {"a.*": 2 if stack == "multi" else 1} and values(s, "**") == {}


def test_multi_read_all(spark):
    m = stores.MultiStore([plain(spark), plain(spark)])
    m.stores[1].update_metadata(changes(spark, ["k"]))
    m.stores[1].write(batch(spark, [("k", T, 4)]), T)
    assert {r.value for r in m.read_all("k")[1].collect()} == {4.0}
    m.stores[0].update_metadata(changes(spark, ["k"]))
    with pytest.raises(ValueError):
        m.read_all("k")


def test_repair_moves_series_to_their_stores(spark):
    r = ringed(spark)
    keys = [f"k{i}" for i in range(12)]
    for k, s in enumerate(r.stores):
        own = keys[k::2]
        s.update_metadata(changes(spark, own))
        s.write(batch(spark, [(x, T, k + 1) for x in own]), T)
    before = values(r, "k*")
    moves = {x.key: (x.store, x.wanted) for x in r.verify().collect()}
    assert moves and {x.key for x in r.verify(repair=True, now=T).collect()} == set(moves)
    assert r.verify().count() == 0 and values(r, "k*") == before
    home = {x["key"]: x["store"] for x in r.placed(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    for k, s in enumerate(r.stores):
        assert {x.key for x in s.catalog.collect()} == {x for x in keys if home[x] == k}


def test_literal_reads_ask_one_store(spark):
    r = ringed(spark)
    home = r._of(["k1"])["k1"]
    r.stores[1 - home].update_metadata(changes(spark, ["k1"]))
    r.stores[1 - home].write(batch(spark, [("k1", T, 5)]), T)
    assert values(r, "k1") == {}
    r.read_from_all = True
    assert values(r, "k1") == {("k1", T): 5.0}


def test_queue_rules(spark):
    b = buffer.BufferedStore(plain(spark))
    b.write(batch(spark, [("k", T, 1), ("k", T, 2)]), T)
    b.write(batch(spark, [("k", T, 3)]), T)
    assert [(r.ts, r.value) for r in b.points.collect()] == [(T, 3.0)]  # the last arrival
    (r,) = b.update_metadata(changes(spark, ["k"]), behavior=cat.IGNORE).collect()
    assert r.ignored
    b.update_metadata(changes(spark, ["k"], "60:10"), behavior=cat.RECREATE)
    assert b.points.count() == 0
    b.write(batch(spark, [("k", T, 7)]), T)
    b.update_metadata(changes(spark, ["k"], "300:10"), behavior=cat.UPDATE)
    (m,) = b.meta.collect()
    assert m.behavior == cat.RECREATE and m.archives[0].precision == 300 and b.points.count() == 1


@pytest.mark.parametrize("new", [cat.UPDATE, cat.IGNORE, cat.RECREATE, None])
@pytest.mark.parametrize("old", [cat.UPDATE, cat.IGNORE, cat.RECREATE, None])
def test_older_commands_go_under_newer_ones(spark, new, old):
    def item(behavior, step, value):
        meta = changes(spark, ["k"], f"{step}:10").withColumns({"behavior": F.lit(behavior), "create_new": F.lit(True)}) if behavior is not None else spark.createDataFrame([], buffer.META)
        return spark.createDataFrame([("k", T, value, 1, 1), ("k", T + int(value), value, 1, 1)], buffer.POINTS), meta

    p, m = item(new, 60, 1.0)
    q, n = item(old, 300, 2.0)
    points, meta = buffer.under(p, m, q, n)
    rows = [(r.behavior, r.archives[0].precision) for r in meta.collect()]
    if new is None:
        want = [] if old is None else [(old, 300)]
    elif new == cat.IGNORE and old is not None:
        want = [(old, 300)]
    else:
        want = [(cat.RECREATE if (new, old) == (cat.UPDATE, cat.RECREATE) else new, 60)]
    assert rows == want
    seconds = {r.ts: r.value for r in points.collect()}
    assert seconds == {T: 1.0, T + 1: 1.0} | ({} if new == cat.RECREATE else {T + 2: 2.0})


def test_bounded_flush_sweeps_the_keys(spark):
    b = buffer.BufferedStore(plain(spark))
    b.update_metadata(changes(spark, ["a", "b", "c"]))
    b.write(batch(spark, [(k, T, 1) for k in "abcd"]), T)
    assert {r.key: r.error for r in b.flush(T, 2).collect()} == {"a": "", "b": ""} and b.position == "c"
    b.write(batch(spark, [("a", T - 60, 9)]), T)
    assert {r.key: r.error for r in b.flush(T, 2).collect()} == {"c": "", "d": "series does not exist"} and b.position == ""
    assert {r.key for r in b.waiting().collect()} == {"a"}
    b.flush(T)
    assert values(b, "**") == {("a", T): 1.0, ("a", T - 60): 9.0, ("b", T): 1.0, ("c", T): 1.0}
    assert {r.name: r.value for r in b.stats().collect() if r.name.startswith("buffer")} == {"buffer.queued_writes": 0, "buffer.queued_points": 0, "buffer.queued_updates": 0}


def test_failed_keys_are_queued_again_under_newer_data(spark):
    b = buffer.BufferedStore(plain(spark), recoverable=F.col("error") == "series does not exist")
    b.write(batch(spark, [("k", T, 1), ("k", T - 60, 2)]), T)
    b.flush(T)
    b.write(batch(spark, [("k", T, 5)]), T)
    assert {r.ts: r.value for r in b.points.collect()} == {T: 5.0, T - 60: 2.0}
    b.update_metadata(changes(spark, ["k"]))
    b.flush(T)
    assert values(b, "k") == {("k", T): 5.0, ("k", T - 60): 2.0}


def test_reads_of_queued_creates_and_recreates(spark):
    b = buffer.BufferedStore(plain(spark))
    b.update_metadata(changes(spark, ["k"], "300:100"))
    head, data = b.read(["k"], T - 600, T, T)
    (h,) = head.collect()
    assert (h.step, h.start_time, h.end_time) == (300, T - 600 + 300 - (T - 600) % 300, T + 300 - T % 300) and data.count() == 0
    b.write(batch(spark, [("k", T, 1), ("k", T - 9000, 2), ("k", T - T % 300, 3)]), T)
    (h,) = b.read(["k"], T - 600, T, T)[0].collect()
    old = T - 9000 - (T - 9000) % 300
    assert values(b, "k") == {("k", T - T % 300): 1.0, ("k", old): 2.0} and (h.start_time, h.end_time) == (old, T - T % 300)
    b.flush(T)
    b.update_metadata(changes(spark, ["k"]), behavior=cat.RECREATE)
    assert values(b, "k") == {}
    s = buffer.BufferedStore(stores.Store.empty(spark, [("auto.**", "120:100", 0.0, "sum")]))
    s.write(batch(spark, [("auto.x", T, 4), ("other", T, 4)]), T)
    assert values(s, "auto.x") == {("auto.x", T - T % 120): 4.0} and values(s, "other") == {}


def test_finds_and_functions_see_the_queue(spark):
    b = buffer.BufferedStore(plain(spark))
    b.update_metadata(changes(spark, ["a.b", "a.c.d"]))
    b.update_metadata(changes(spark, ["a.e"]), create_new=False)
    b.write(batch(spark, [("a.f", T, 1)]), T)
    assert {(r.pattern, r.name) for r in b.find(["a.*", "a.f", "a.none"])[0].collect()} == {("a.*", "a.b"), ("a.*", "a.c.*"), ("a.f", "a.f")}
    b.find_patterns = False
    assert b.find(["a.*"])[0].count() == 0
    b.flush(T)
    b.write(batch(spark, [("a.b", T, 2), ("a.c.d", T, 3)]), T)
    b.flush(T)
    b.write(batch(spark, [("a.b", T, 5)]), T)
    assert [r.value for r in evaluate(b, "sumSeries(a.**)", T - 600, T, T).result().collect()] == [8.0]


def test_deletes_and_renames_reach_the_queue(spark):
    b = buffer.BufferedStore(plain(spark))
    b.update_metadata(changes(spark, ["a.b", "a.c"]))
    b.flush(T)
    b.write(batch(spark, [("a.b", T, 1), ("a.d", T, 2)]), T)
    assert {r.key: r.error for r in b.rename_series([("a.b", "x.b"), ("a.d", "x.d")], now=T).collect()} == {"a.b": "", "a.d": "series does not exist"}
    assert {r.key for r in b.waiting().collect()} == {"x.b", "a.d"}  # a name that could not be renamed keeps its points
    (r,) = b.delete_series(["a.*"], defer=True).collect()
    assert (r.deleted, r.buffer_deleted) == (0, 1) and b.store.catalog.count() == 2
    assert [r.deleted for r in b.run_deletes().collect()] == [1] and b.deletes == []
    assert {r.key for r in b.store.catalog.collect()} == {"x.b"}


def test_rate_limit():
    used = []
    waits = [buffer.rate_limited(2, 10.0, used, t) for t in (0.0, 1.0, 2.0, 9.5, 10.0, 11.0, 12.0)]
    assert waits == [0, 0, 8.0, 0.5, 0, 0, 8.0]


def test_commits_rewrite_only_touched_buckets(spark, tmp_path):
    p = str(tmp_path / "store")
    rules = [("**", S, 0.0, "sum")]
    keys = [f"k{i}" for i in range(30)]
    assert tables.commit(spark, p, batch(spark, [(k, T, 1) for k in keys]), T, rules) == 1
    assert tables.commit(spark, p, batch(spark, [("k3", T - 60, 2), ("k3", T, 9)]), T, rules) == 2
    first, second = tables.manifest(spark, p, 1), tables.manifest(spark, p, 2)
    (own,) = (r[0] for r in spark.createDataFrame([("k3",)], "key string").select(tables.bucket_of(first["buckets"])).collect())
    assert {b for b in second["at"] if second["at"][b] != first["at"].get(b)} == {own} and second["at"][own] == 2
    s = tables.load(spark, p, rules)
    assert values(s, "k*") == {(k, T): 1.0 for k in keys} | {("k3", T - 60): 2.0, ("k3", T): 9.0}
    assert values(tables.load(spark, p, rules, 1), "k3") == {("k3", T): 1.0}
    assert tables.commit(spark, p, batch(spark, []), T, rules) == 2
    gone = tables.vacuum(spark, p)
    assert len(gone) == 2 and tables.versions(spark, p) == [2] and all(f"/v1/" in g and g.endswith(f"bucket={own}") for g in gone)
    assert values(tables.load(spark, p, rules), "k*")[("k3", T)] == 9.0
    with pytest.raises(tables.ConflictError):
        tables._publish(spark, p, 2, second)


def test_requests(spark):
    s = plain(spark)
    say = lambda line: requests.run_command(s, line, T)
    assert [r.error for r in say("create a.b 60:1000 0.5 sum").collect()] == [""]
    say("create a.c 60:1000 0.5 sum")
    assert [r.error for r in say(f"write a.b {T} 1.5 -1m 2").collect()] == [""]
    assert {(r.ts, r.value) for r in say("read a.b").collect()} == {(T, 1.5), (T - 60, 2.0)}
    assert {(r.ts, r.value) for r in say("read a.b +start=-30s +end=now").collect()} == {(T, 1.5)}
    assert [r.results for r in say("find +count a.*").collect()] == [2] and [r.name for r in say("find").collect()] == ["a.*"]
    assert {r.error for r in say("update-metadata a.* 120:1000 0.1 max").collect()} == {""}
    assert {(r.archives[0].precision, r.agg) for r in s.catalog.collect()} == {(120, 5)}
    assert {r.error for r in say("update-metadata no 60:10 0 sum").collect()} == {"series does not exist"}
    assert [r.error for r in say("rename a.c x.y").collect()] == [""] and [r.deleted for r in say("delete x.*").collect()] == [1]
    assert "points.tier0" in {r["name"] for r in say("stats").collect()} and say("help").count() == len(requests.COMMANDS)
    for bad in ("", "nothing", "delete", "rename a", "create a* 60:10 0 sum", "update-metadata a.* 60:10 0 sum +skip-existing", "write a.b 1", "verify start", "create a 60:10 0 odd", "read a +x=1"):
        with pytest.raises(requests.RequestError):
            say(bad)
    r = ringed(spark)
    assert [x.read_from_all for x in requests.run_command(r, "read-from-all on", T).collect()] == [True] and requests.run_command(r, "verify start repair", T).count() == 0

    kind, body = requests.render_reply(s, "target=a.b&target=sumSeries%28a.%2A%29&target=bad%28&from=-10min&noCache=1", T)
    assert kind == "application/json" and '"target":"a.b"' in body and '"target":"sumSeries(a.*)"' in body
    (d,) = pickle.loads(requests.render_reply(s, "target=a.b&format=pickle", T)[1])
    assert d["pathExpression"] == "a.b" and d["step"] == 120
    assert '"datapoints":[[' in requests.render_reply(s, "target=a.b&maxDataPoints=1", T)[1]
    kind, body = requests.render_reply(s, "target=a.b&target=constantLine(1)&format=png", T)
    assert kind == "image/png" and body.startswith(b"\x89PNG") and requests.render_reply(s, "format=png", T)[1].endswith(b"IEND\xaeB`\x82")
    assert requests.time_range(None, None, T) == (T - 3600, T) and requests.time_range("-2h", "-1h", T) == (T - 7200, T - 3600)
    assert requests.find_reply(s, "query=a.%2A&format=json")[1] == '{"a.*": ["a.b"]}' and '"text": "b"' in requests.find_reply(s, "query=a.*")[1]
    assert pickle.loads(requests.find_reply(s, "format=pickle")[1]) == [{"intervals": [], "isLeaf": False, "metric_path": "a"}]
    assert "<a href" in requests.find_reply(s, "query=a.*&format=html")[1]
    for call in (lambda: requests.render_reply(s, "what=1", T), lambda: requests.render_reply(s, "format=gif", T), lambda: requests.find_reply(s, "query=a&query=b"), lambda: requests.find_reply(s, "format=png")):
        with pytest.raises(requests.RequestError):
            call()
