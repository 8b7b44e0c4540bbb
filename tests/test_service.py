"""The service over a store, its HTTP front, clients, remote stores, sockets and ring files."""

import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import buffer, stores
from tidemark.operators import catalog as cat
from tidemark.plans.service import RemoteStore, Service, reply, serve
from tidemark.sources import clients, lines, pickled, ringfile
from tidemark.streaming import sockets

T = 1_700_000_040
META = {"archives": [(60, 1000)], "xff": 0.0, "agg": 2}


@pytest.fixture
def service(spark):
    return Service(stores.Store.empty(spark, [("auto.**", "60:100", 0.0, "sum")]), lambda: T)


def test_calls(spark, service):
    assert service.update_metadata({"a.b": META, "bad key": META}) == {"a.b": {"description": "", "ignored": False}, "bad key": {"description": "key contains invalid characters", "ignored": True}}
    assert service.update_metadata({"a.b": META}, skip_existing_series=True)["a.b"]["ignored"]
    assert service.write({"a.b": [(0, 1.0), (T - 60, 2.0)], "none": [(T, 1.0)]}) == {"a.b": {"description": "", "ignored": False}, "none": {"description": "series does not exist", "ignored": False}}
    assert service.read(["a.*"])["a.*"]["a.b"] == {"start_time": T - 3600 + 60, "end_time": T + 60, "step": 60, "data": [(T - 60, 2.0), (T, 1.0)]}
    assert service.read_all("a.b") == {"metadata": {"archives": [(60, 1000)], "xff": 0.0, "agg": 2}, "data": [(T - 60, 2.0), (T, 1.0)]}
    assert service.read_all("none") == {"metadata": None, "data": []}
    assert service.find(["*", "**.x"])["*"] == {"results": ["a.*"], "error": ""} and service.find(["**.x"])["**.x"]["error"]
    assert service.rename_series({"a.b": "a.c"})["a.b"]["description"] == "" and service.stats()["series"] == 1
    assert service.delete_series(["a.*"]) == {"a.*": {"deleted": 1}}
    assert not service.start_verify() and not service.cancel_verify() and service.set_read_from_all(True) is False


def test_calls_on_stores_of_stores(spark):
    places = [("h", "a"), ("h", "b")]
    ring = Service(stores.RingStore([stores.Store.empty(spark) for _ in places], places=places), lambda: T)
    assert ring.set_read_from_all(True) is False and ring.get_read_from_all() is True
    assert ring.start_verify(True) and ring.get_verify_status() == {"keys_moved": 0, "in_progress": 0, "repair": 1}
    held = Service(buffer.BufferedStore(stores.Store.empty(spark)), lambda: T)
    held.update_metadata({"k": META}, skip_buffering=True)
    held.write({"k": [(T, 1.0)]}, skip_buffering=True)
    held.write({"k": [(T - 60, 2.0)]})
    assert held.read_all("k")["data"] == [(T, 1.0)] and len(held.read(["k"])["k"]["k"]["data"]) == 2
    assert held.delete_series(["k"], deferred=True) == {"k": {"deleted": 0, "buffer_deleted": 1}}


def test_remote_store_forwards_and_can_stand_in_a_multi_store(spark, service):
    far = RemoteStore(spark, service)
    both = stores.MultiStore([stores.Store.empty(spark), far])
    c = spark.createDataFrame([("k", [(60, 1000)], 0.0, 2)], cat.CATALOG)
    assert [r.error for r in both.update_metadata(c).collect()] == [""]
    rows = spark.createDataFrame([("k", T, 3.0, 0)], "key string, ts bigint, value double, arrival bigint")
    assert [r.error for r in both.write(rows, T).collect()] == [""]
    assert service.read_all("k")["data"] == [(T, 3.0)] and {r.name for r in both.find(["*"])[0].collect()} == {"k"}
    assert [r.value for r in far.read(["k"], T - 60, T, T)[1].collect()] == [3.0] and far.stats().count() >= 1
    assert [r.error for r in far.rename_series([("k", "m")]).collect()] == [""] and [r.deleted for r in far.delete_series(["m"]).collect()] == [1]
    silent = RemoteStore(spark, service, local_only=True)
    assert silent.write(rows, T).count() == 0 and silent.find(["*"])[0].count() == 0 and silent.read(["k"], 0, T, T)[0].count() == 0

    class Down:
        def write(self, *_, **__):
            raise ConnectionError

    held = buffer.BufferedStore(RemoteStore(spark, Down()), recoverable=F.col("error") == RemoteStore.UNREACHABLE)
    held.write(rows, T)
    assert [r.error for r in held.flush(T).collect()] == [RemoteStore.UNREACHABLE] and held.waiting().count() == 1


def test_http_front_and_reader(service):
    service.update_metadata({"a.b": META})
    service.write({"a.b": [(T, 1.5)]})
    server = serve(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        r = clients.HttpReader(f"http://127.0.0.1:{server.server_port}")
        assert r.read(["a.b", "scale(a.*,2)"], "-10min") == {"a.b": [(3.0, T)]} or r.read(["a.b"]) == {"a.b": [(1.5, T)]}
        assert r.read_pickle("a.b")[0]["values"][-1] == 1.5 and r.find(["a.*"]) == {"a.*": ["a.b"]} and r.read_all("a.b")["data"] == [[T, 1.5]]
    finally:
        server.shutdown()
        server.server_close()
    assert reply(service, "/y/stats")[0] == 200 and reply(service, "/y/config")[0] == 200 and reply(service, "/y/thread-status")[0] == 200
    assert reply(service, "/y/action?command=find+a.*")[2] == b'[{"pattern": "a.*", "name": "a.b", "is_directory": false}]'
    assert reply(service, "/nothing")[0] == 404 and reply(service, "/render?format=gif")[0] == 400 and reply(service, "/metrics/find?query=x&query=y")[0] == 400
    assert reply(service, "/render?target=a.b&from=junk")[0] in (400, 500)


def test_writers(spark):
    got = {}

    def listen(server, name):
        c, _ = server.accept()
        with c:
            got[name] = b"".join(iter(lambda: c.recv(4096), b""))

    points = [("a.b", T, 1.25), ("c", T - 60, -3.0)]
    for name, kind in (("line", clients.LineWriter), ("pickle", clients.PickleWriter)):
        with socket.create_server(("127.0.0.1", 0)) as server:
            t = threading.Thread(target=listen, args=(server, name))
            t.start()
            with kind("127.0.0.1", server.getsockname()[1]) as w:
                w.write(points)
            t.join()
    text = spark.createDataFrame([(x,) for x in got["line"].decode().splitlines()], "value string")
    assert sorted((r.key, r.ts, r.value) for r in lines.parse_lines(text, T).collect()) == points
    blobs = spark.createDataFrame([(bytearray(got["pickle"]),)], "content binary")
    assert sorted((r.key, r.ts, r.value) for r in pickled.parse_pickled(blobs).collect()) == points


def test_datagram_stream(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    q = lines.parse_datagrams(sockets.datagrams(spark, port), F.col("read_at")).writeStream.format("memory").queryName("grams").start()
    try:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        seen = set()
        for _ in range(60):
            out.sendto(b"a 1 5\nb 2 6\n", ("127.0.0.1", port))
            time.sleep(1)
            seen = {(r.key, r.ts, r.value) for r in spark.table("grams").collect()}
            if seen:
                break
        assert seen == {("a", 5, 1.0), ("b", 6, 2.0)}
    finally:
        q.stop()


def test_ring_files_round_trip(spark):
    s = stores.Store.empty(spark, [("**", "60:10,600:20", 0.0, "sum")])
    rows = [("a.b", T, 1.0, 0), ("a.b", T - 120, 2.0, 1), ("c", T - 60, 4.0, 2)]
    s.write(spark.createDataFrame(rows, "key string, ts bigint, value double, arrival bigint"), T)
    extra = spark.createDataFrame([("empty", [(60, 10)], 0.5, 1)], cat.CATALOG)
    files = ringfile.encoded(s.catalog.unionByName(extra), s.points)
    assert {r.path for r in files.collect()} == {"a/b.wsp", "c.wsp", "empty.wsp"}
    catalog, points = ringfile.decoded(files)
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, s.points.collect()))
    assert {(r.key, r.xff, r.agg) for r in catalog.collect()} == {("a.b", 0.0, 2), ("c", 0.0, 2), ("empty", 0.5, 1)}


def test_picture(spark):
    import struct
    import zlib

    import numpy as np

    from tidemark.plans.evaluate import evaluate
    from tidemark.sources import image

    s = stores.Store.empty(spark, [("**", "60:100", 0.0, "sum")])
    s.write(spark.createDataFrame([("up", T - 60 * i, float(-i), i) for i in range(10)], "key string, ts bigint, value double, arrival bigint"), T)
    body = image.png_document(evaluate(s, 'color(up,"red")', T - 600, T + 1, T + 60), 40, 30)
    w, h = struct.unpack(">II", body[16:24])
    at = body.index(b"IDAT")
    raw = zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]])
    pixels = np.frombuffer(raw, np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)
    assert (w, h) == (40, 30) and tuple(pixels[29, 0]) == tuple(pixels[0, 39]) == image.COLORS["red"] and tuple(pixels[0, 0]) == (255, 255, 255)
