"""A service over a store: plain Python values in and out, and an HTTP front for reads.

``Service`` has one method for each call of a remote client.  Replies are collected, so
they are meant for results that fit a reply; large ones stay frames in the store's own API.
"""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import catalog as cat
from tidemark.operators.stores import Store
from tidemark.plans import requests


class Service:
    """Calls on a store by plain values.

    ``clock`` gives the present second.  ``skip_buffering`` passes a buffer by where the
    store has one; ``local_only`` asks a store that forwards calls (``RemoteStore``) for
    nothing.
    """

    def __init__(self, store, clock=lambda: int(time.time())):
        self.store, self.clock = store, clock
        self.verified = {"keys_moved": 0, "in_progress": 0, "repair": 0}

    def _target(self, skip_buffering: bool):
        return self.store.store if skip_buffering and hasattr(self.store, "flush") else self.store

    @staticmethod
    def _outcomes(rows: DataFrame) -> dict[str, dict]:
        return {r["key"]: {"description": r["error"], "ignored": r["ignored"]} for r in rows.collect()}

    def update_metadata(self, metadata: dict[str, dict], create_new: bool = True, skip_existing_series: bool = False, truncate_existing_series: bool = False, skip_buffering: bool = False, local_only: bool = False) -> dict[str, dict]:
        """``metadata``: key to archives [(step, points)], xff and agg (its number)."""
        rows = [(k, [tuple(a) for a in m["archives"]], float(m["xff"]), int(m["agg"])) for k, m in metadata.items()]
        behavior = cat.RECREATE if truncate_existing_series else cat.IGNORE if skip_existing_series else cat.UPDATE
        return self._outcomes(self._target(skip_buffering).update_metadata(self.store.spark.createDataFrame(rows, cat.CATALOG), behavior=behavior, create_new=create_new, now=self.clock()))

    def delete_series(self, patterns: list[str], deferred: bool = False, local_only: bool = False) -> dict[str, dict]:
        rows = self.store.delete_series(patterns, **({"defer": True} if deferred and hasattr(self.store, "run_deletes") else {}))
        return {r["pattern"]: {k: v for k, v in r.asDict().items() if k != "pattern"} for r in rows.collect()}

    def rename_series(self, renames: dict[str, str], merge: bool = False, local_only: bool = False) -> dict[str, dict]:
        return self._outcomes(self.store.rename_series(list(renames.items()), merge=merge, now=self.clock()))

    def write(self, data: dict[str, list[tuple[int, float]]], skip_buffering: bool = False, local_only: bool = False) -> dict[str, dict]:
        """``data``: key to (second, value) pairs; a time of 0 is now."""
        now = self.clock()
        flat = [(k, int(t) or now, float(v)) for k, pairs in data.items() for t, v in pairs]
        rows = self.store.spark.createDataFrame([(*r, i) for i, r in enumerate(flat)], "key string, ts bigint, value double, arrival bigint")
        return self._outcomes(self._target(skip_buffering).write(rows, now))

    def read(self, targets: list[str], start_time: int = 0, end_time: int = 0, local_only: bool = False) -> dict[str, dict[str, dict]]:
        """query to name to start_time, end_time, step and data."""
        now = self.clock()
        end = end_time or now
        head, data = self.store.read(targets, start_time or end - requests.HOUR, end, now)
        out: dict[str, dict[str, dict]] = {t: {} for t in targets}
        for r in head.collect():
            out[r["query"]][r["name"]] = {"start_time": r["start_time"], "end_time": r["end_time"], "step": r["step"], "data": []}
        for r in data.orderBy("query", "name", "ts").collect():
            out[r["query"]][r["name"]]["data"].append((r["ts"], r["value"]))
        return out

    def read_all(self, series: str, local_only: bool = False) -> dict:
        rows, points = self.store.read_all(series)
        m = rows.first()
        meta = None if m is None else {"archives": [(a["precision"], a["points"]) for a in m["archives"]], "xff": m["xff"], "agg": m["agg"]}
        return {"metadata": meta, "data": [(r["ts"], r["value"]) for r in points.orderBy("tier", "ts").collect()]}

    def find(self, patterns: list[str], local_only: bool = False) -> dict[str, dict]:
        found, errors = self.store.find(patterns)
        out = {p: {"results": [], "error": ""} for p in patterns}
        for r in errors.collect():
            out[r["pattern"]]["error"] = r["error"]
        for r in found.orderBy("name").collect():
            out[r["pattern"]]["results"].append(r["name"])
        return out

    def stats(self) -> dict[str, int]:
        return {r["name"]: r["value"] for r in self.store.stats().collect()}

    def get_verify_status(self) -> dict[str, int]:
        return dict(self.verified)

    def start_verify(self, repair: bool = False) -> bool:
        """Check (and with ``repair`` mend) the places of all keys; the call returns when that is done."""
        if not hasattr(self.store, "verify"):
            return False
        self.verified = {"keys_moved": self.store.verify(repair=repair, now=self.clock()).count(), "in_progress": 0, "repair": int(repair)}
        return True

    def cancel_verify(self) -> bool:
        """False: a verification is one call, so none is ever running."""
        return False

    def get_read_from_all(self) -> bool:
        return bool(getattr(self.store, "read_from_all", False))

    def set_read_from_all(self, read_from_all: bool) -> bool:
        """The setting before."""
        before = self.get_read_from_all()
        if hasattr(self.store, "read_from_all"):
            self.store.read_from_all = read_from_all
        return before


class RemoteStore:
    """A store behind a service of another process: every call is forwarded.

    ``service`` has the methods of ``Service``.  ``local_only`` answers every call with
    nothing, as a cluster node does for keys that other nodes hold.  A call that cannot
    reach the service is an error of each of its keys that can be tried again.
    """

    UNREACHABLE = "the remote store cannot be reached"

    def __init__(self, spark, service, local_only: bool = False):
        self.spark, self.service, self.local_only, self.events = spark, service, local_only, None

    def _results(self, keys: list[str], call) -> DataFrame:
        if self.local_only:
            rows = []
        else:
            try:
                rows = [(k, e["description"], e["ignored"]) for k, e in call().items()]
            except OSError:
                rows = [(k, self.UNREACHABLE, False) for k in keys]
        return self.spark.createDataFrame(rows, cat.RESULT)

    def write(self, batch: DataFrame, now: int) -> DataFrame:
        data: dict[str, list[tuple[int, float]]] = {}
        for r in batch.orderBy("key", "arrival").collect():
            data.setdefault(r["key"], []).append((r["ts"], r["value"]))
        return self._results(list(data), lambda: self.service.write(data, skip_buffering=True))

    def update_metadata(self, changes: DataFrame, behavior: int = cat.UPDATE, create_new: bool = True, now: int | None = None) -> DataFrame:
        meta = {r["key"]: {"archives": [tuple(a) for a in r["archives"]], "xff": r["xff"], "agg": r["agg"]} for r in changes.collect()}
        return self._results(list(meta), lambda: self.service.update_metadata(meta, create_new, behavior == cat.IGNORE, behavior == cat.RECREATE, True))

    def rename_series(self, names: list[tuple[str, str]], merge: bool = False, now: int | None = None) -> DataFrame:
        return self._results([a for a, _ in names], lambda: self.service.rename_series(dict(names), merge))

    def delete_series(self, patterns: list[str]) -> DataFrame:
        out = {} if self.local_only else self.service.delete_series(patterns)
        return self.spark.createDataFrame([(p, out.get(p, {}).get("deleted", 0)) for p in patterns], "pattern string, deleted bigint")

    def find(self, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
        out = {p: {"results": [], "error": ""} for p in patterns} if self.local_only else self.service.find(patterns)
        rows = [(p, n, n.endswith(".*")) for p, x in out.items() for n in x["results"]]
        return self.spark.createDataFrame(rows, "pattern string, name string, is_directory boolean"), self.spark.createDataFrame([(p, x["error"]) for p, x in out.items()], "pattern string, error string")

    def read(self, patterns: list[str], start: int, end: int, now: int) -> tuple[DataFrame, DataFrame]:
        out = {} if self.local_only else self.service.read(patterns, start, end)
        head = [(q, n, r["step"], r["start_time"], r["end_time"]) for q, x in out.items() for n, r in x.items()]
        data = [(q, n, t, v) for q, x in out.items() for n, r in x.items() for t, v in r["data"]]
        return self.spark.createDataFrame(head, "query string, name string, step bigint, start_time bigint, end_time bigint"), self.spark.createDataFrame(data, "query string, name string, ts bigint, value double")

    def stats(self) -> DataFrame:
        return self.spark.createDataFrame(list(({} if self.local_only else self.service.stats()).items()), "name string, value bigint")


def reply(service: Service, url: str) -> tuple[int, str, bytes]:
    """Status, content type and body of a GET request."""
    parts = urlsplit(url)
    place, query = parts.path.rstrip("/"), parts.query
    try:
        match place:
            case "/render":
                kind, body = requests.render_reply(service.store, query, service.clock())
            case "/metrics/find":
                kind, body = requests.find_reply(service.store, query)
            case "/y/stats":
                kind, body = "application/json", json.dumps(service.stats())
            case "/y/read-all":
                kind, body = "application/json", json.dumps(service.read_all(parse_qs(query).get("target", [""])[0]))
            case "/y/config":
                kind, body = "application/json", json.dumps({"read_from_all": service.get_read_from_all(), "rules": [list(r) for r in getattr(service.store, "rules", [])]})
            case "/y/action":
                line = parse_qs(query).get("command", [""])[0]
                rows = requests.run_command(service.store, line, service.clock())
                kind, body = "application/json", json.dumps([r.asDict(True) for r in rows.collect()])
            case "/y/thread-status":
                t = service.store.spark.sparkContext.statusTracker()
                kind, body = "application/json", json.dumps({"jobs": list(t.getActiveJobsIds()), "stages": list(t.getActiveStageIds())})
            case _:
                return 404, "text/plain", b"unknown action"
    except requests.RequestError as e:
        return 400, "text/plain", str(e).encode()
    except Exception as e:  # the server lives on; the client sees what failed
        return 500, "text/plain", f"error during request: {e}".encode()
    return 200, kind, body if isinstance(body, bytes) else body.encode()


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server for ``reply``, not yet running: call ``serve_forever`` and ``shutdown``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = reply(service, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def report(store: Store, into: Store, host: str, every: str = "60 seconds", clock=lambda: int(time.time())):
    """A streaming query that writes the stats of ``store`` into ``into`` as series, once each interval."""
    from tidemark.sources.render import stat_points

    def write(_batch, _id):
        now = clock()
        into.write(stat_points(store.stats(), host, now).withColumn("arrival", F.lit(0).cast("bigint")), now)

    return store.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(write).trigger(processingTime=every).start()
