"""Text requests: the calls of a read service and the lines of a command shell, without a network.

Replies to reads are (content type, body); commands return a frame, so that large results
stay distributed.
"""

from __future__ import annotations

import pickle
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import glob, timeparse
from tidemark.operators import catalog as cat
from tidemark.operators import ingest
from tidemark.plans.evaluate import Context
from tidemark.plans.frame import consolidated, union
from tidemark.plans.language import QueryError, parse
from tidemark.sources import image
from tidemark.sources import render as sinks

HOUR = 3600


class RequestError(ValueError):
    """The request cannot be understood."""


def time_range(start: str | None, until: str | None, now: int) -> tuple[int, int]:
    """Both ends; the end is now and the start an hour before the end unless given."""
    end = timeparse.relative_time(until, now) if until else now
    return (timeparse.relative_time(start, now) if start else end - HOUR), end


def render_reply(store, query_string: str, now: int) -> tuple[str, str | bytes]:
    """``target`` (any number), ``from``, ``until``, ``format`` (json, pickle, png; json if not given), ``maxDataPoints``."""
    given: dict[str, str] = {}
    targets = []
    for name, value in parse_qsl(query_string, keep_blank_values=True):
        if name == "target":
            targets.append(value)
        elif name in ("from", "until", "format", "maxDataPoints"):
            given[name] = value
        elif name not in ("now", "noCache", "local"):
            raise RequestError(f"unknown argument: {name}")
    start, end = time_range(given.get("from"), given.get("until"), now)
    kind = given.get("format", "") or "json"
    if kind not in ("json", "pickle", "png"):
        raise RequestError(f"unknown format: {kind}")
    ctx, found = Context(store, start, end, now), []
    for t in targets:
        try:
            s = ctx.evaluate(parse(t))
            found.append((t, consolidated(s, int(given["maxDataPoints"])) if "maxDataPoints" in given else s))
        except (QueryError, ValueError):  # a wrong target is left out, the others are shown
            continue
    if kind == "json":
        return "application/json", "[" + ",".join(x for _, s in found if (x := sinks.json_document(s)[1:-1])) + "]"
    if kind == "png":
        return "image/png", image.png_document(union([s for _, s in found])) if found else image.png(image.np.full((600, 800, 3), 255, image.np.uint8))
    return "application/pickle", pickle.dumps([row for t, s in found for row in pickle.loads(sinks.pickle_document(s, t))], protocol=2)


def find_reply(store, query_string: str) -> tuple[str, str | bytes]:
    """``query`` (any number; the root without one) and ``format`` (one query's nodes if not given; json, html, pickle)."""
    args = parse_qsl(query_string, keep_blank_values=True)
    queries = [v for k, v in args if k == "query"] or ["*"]
    kind = dict(args).get("format", "")
    found = store.find(queries)[0]
    if kind in ("", "pickle") and len(queries) > 1:
        raise RequestError("only one pattern can be shown")
    if kind == "":
        return "application/json", sinks.graphite_find(found)
    if kind == "json":
        return "application/json", sinks.json_find(found)
    if kind == "html":
        return "text/html", sinks.html_find(found)
    if kind == "pickle":
        rows = found.orderBy("name").collect()
        return "application/pickle", pickle.dumps([{"intervals": [], "isLeaf": not r.is_directory, "metric_path": r.name[:-2] if r.is_directory else r.name} for r in rows], protocol=2)
    raise RequestError(f"unknown format: {kind}")


def _flags(words: list[str], allowed: tuple[str, ...]) -> tuple[list[str], dict[str, str]]:
    """Words without a leading plus, and the flags (``+name`` or ``+name=value``)."""
    rest = [w for w in words if not w.startswith("+")]
    flags = dict((w[1:].split("=", 1) + [""])[:2] for w in words if w.startswith("+"))
    if unknown := set(flags) - set(allowed):
        raise RequestError(f"unknown argument: +{min(unknown)}")
    return rest, flags


def _find(store, words, now):
    rest, flags = _flags(words, ("count",))
    found = store.find(rest or ["*"])[0]
    return found.groupBy("pattern").agg(F.count("*").alias("results")) if "count" in flags else found.orderBy("pattern", "name")


def _read(store, words, now):
    rest, flags = _flags(words, ("start", "end"))
    if len(rest) != 1:
        raise RequestError("read takes one pattern")
    return store.read(rest, *time_range(flags.get("start"), flags.get("end"), now), now)[1]


def _write(store, words, now):
    if len(words) < 3 or len(words) % 2 == 0:
        raise RequestError("write takes a series and pairs of time and value")
    pairs = zip(words[1::2], words[2::2], strict=True)
    rows = [(words[0], now if t == "0" else timeparse.relative_time(t, now), float(v), i) for i, (t, v) in enumerate(pairs)]
    return store.write(store.spark.createDataFrame(rows, "key string, ts bigint, value double, arrival bigint"), now)


def _delete(store, words, now):
    rest, flags = _flags(words, ("defer",))
    if not rest:
        raise RequestError("no series given")
    return store.delete_series(rest, **({"defer": True} if "defer" in flags and hasattr(store, "run_deletes") else {}))


def _rename(store, words, now):
    rest, flags = _flags(words, ("merge",))
    if not rest or len(rest) % 2:
        raise RequestError("rename takes pairs of names")
    return store.rename_series(list(zip(rest[::2], rest[1::2], strict=True)), merge="merge" in flags, now=now)


def _update(store, words, now, create=False):
    rest, flags = _flags(words, ("create", "skip-existing", "truncate"))
    if len(rest) != 4 or rest[3] not in ingest.METHOD_NUMBER:
        raise RequestError("a series, archives, a factor and a method are needed")
    create, skip = create or "create" in flags, "skip-existing" in flags
    if glob.is_pattern(rest[0]):
        if create or skip:
            raise RequestError("a pattern cannot create or skip series")
        found, errors = store.find([rest[0]])
        if bad := errors.where("error <> ''").first():
            raise RequestError(bad["error"])
        keys = found.where("NOT is_directory").select(F.col("name").alias("key")).distinct()
    else:
        keys = store.spark.createDataFrame([(rest[0],)], "key string")
    rows = keys.select("key", ingest.archives_column(rest[1]).alias("archives"), F.lit(timeparse.xff(float(rest[2]))).alias("xff"), F.lit(ingest.METHOD_NUMBER[rest[3]]).alias("agg"))
    behavior = cat.RECREATE if "truncate" in flags else cat.IGNORE if skip else cat.UPDATE
    return store.update_metadata(rows, behavior=behavior, create_new=create, now=now)


def _verify(store, words, now):
    if words not in (["start"], ["start", "repair"]) or not hasattr(store, "verify"):
        raise RequestError("verify start [repair] needs a store that shares keys")
    return store.verify(repair="repair" in words, now=now)


def _read_from_all(store, words, now):
    if words not in ([], ["on"], ["off"]) or not hasattr(store, "read_from_all"):
        raise RequestError("read-from-all [on|off] needs a store that shares keys")
    if words:
        store.read_from_all = words == ["on"]
    return store.spark.createDataFrame([(store.read_from_all,)], "read_from_all boolean")


def _stats(store, words, now):
    return store.stats().orderBy("name")


#: Commands and the arguments they take.
COMMANDS = {
    "find": (_find, "[+count] [<pattern> ...]"),
    "read": (_read, "<pattern> [+start=<time>] [+end=<time>]"),
    "write": (_write, "<series> <time> <value> [<time> <value> ...]"),
    "delete": (_delete, "[+defer] <pattern> [<pattern> ...]"),
    "rename": (_rename, "[+merge] <series> <series> [<series> <series> ...]"),
    "create": (lambda s, w, n: _update(s, w, n, True), "<series> <archives> <factor> <method> [+skip-existing] [+truncate]"),
    "update-metadata": (_update, "<series or pattern> <archives> <factor> <method> [+create] [+skip-existing] [+truncate]"),
    "stats": (_stats, ""),
    "verify": (_verify, "start [repair]"),
    "read-from-all": (_read_from_all, "[on|off]"),
}


def run_command(store, line: str, now: int) -> DataFrame:
    """The result of one command line; ``help`` lists the commands."""
    name, *words = line.split() or [""]
    if name == "help":
        return store.spark.createDataFrame([(k, v) for k, (_, v) in COMMANDS.items()], "command string, arguments string")
    if name not in COMMANDS:
        raise RequestError(f"unknown command: {name or '(empty)'}")
    return COMMANDS[name][0](store, words, now)
