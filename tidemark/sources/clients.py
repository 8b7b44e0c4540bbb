"""Clients: writers of the line and pickle protocols, and a reader of the HTTP front."""

from __future__ import annotations

import json
import pickle
import socket
from urllib.parse import urlencode
from urllib.request import urlopen

from . import pickled


class _Writer:
    def __init__(self, host: str, port: int, timeout: float = 10.0):
        self.socket = socket.create_connection((host, port), timeout)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.socket.close()


class LineWriter(_Writer):
    """Points as lines ``key value ts`` over a connection."""

    def write(self, points: list[tuple[str, int, float]]) -> None:
        """(key, second, value) of each point; second 0 is the receiver's now."""
        self.socket.sendall("".join(f"{k} {v!r} {t}\n" for k, t, v in points).encode())


class PickleWriter(_Writer):
    """Points as length-prefixed pickled lists over a connection."""

    def write(self, points: list[tuple[str, int, float]]) -> None:
        self.socket.sendall(pickled.encode(points))


class HttpReader:
    """Reads and finds over HTTP."""

    def __init__(self, base: str, timeout: float = 60.0):
        self.base, self.timeout = base.rstrip("/"), timeout

    def _get(self, place: str, args: list[tuple[str, str]]) -> bytes:
        with urlopen(f"{self.base}{place}?{urlencode(args)}", timeout=self.timeout) as r:
            return r.read()

    def read(self, targets: list[str], start: str | int = "", until: str | int = "") -> dict[str, list[tuple[float, int]]]:
        """name to (value, second) pairs; start and until may be relative."""
        args = [("target", t) for t in targets] + [("format", "json")] + [(k, str(v)) for k, v in (("from", start), ("until", until)) if v != ""]
        return {x["target"]: [tuple(p) for p in x["datapoints"]] for x in json.loads(self._get("/render", args))}

    def read_pickle(self, target: str) -> list[dict]:
        return pickle.loads(self._get("/render", [("target", target), ("format", "pickle")]))

    def read_all(self, series: str) -> dict:
        return json.loads(self._get("/y/read-all", [("target", series)]))

    def find(self, patterns: list[str]) -> dict[str, list[str]]:
        return json.loads(self._get("/metrics/find", [("query", p) for p in patterns] + [("format", "json")]))
