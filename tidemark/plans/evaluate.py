"""Evaluation of query texts over a store: syntax tree to a pair of frames.

Every distinct series reference of all targets is scanned once and its frames shared.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import catalogue
from tidemark.plans.frame import Series, consolidated
from tidemark.plans.language import Call, Const, QueryError, Ref, parse

#: Bare words that are constants as arguments.
WORDS = {"None": None, "none": None, "True": True, "true": True, "False": False, "false": False, "inf": float("inf")}


@dataclass
class Context:
    store: object  # has read_series(pattern, start, end, now) and events
    start: int
    end: int
    now: int
    default_step: int = 60
    scans: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def between(self, start: int, end: int) -> "Context":
        return replace(self, start=start, end=end)

    def read(self, pattern: str) -> Series:
        key = (pattern, self.start, self.end)
        if key not in self.scans:
            self.scans[key] = self.store.read_series(pattern, self.start, self.end, self.now)
        return self.scans[key]

    def read_where(self, keep) -> Series:
        """The series whose catalogue rows ``keep`` (a function of the catalogue) leaves, and their points only."""
        return self.store.read_series("**", self.start, self.end, self.now, keep=keep)

    def value(self, node):
        """The constant a node stands for."""
        if isinstance(node, Const):
            return node.value
        if isinstance(node, Ref) and node.text in WORDS:
            return WORDS[node.text]
        raise QueryError(f"a constant is needed, not {getattr(node, 'text', node)!r}")

    def argument(self, node):
        if isinstance(node, Const) or isinstance(node, Ref) and node.text in WORDS:
            return self.value(node)
        return self.evaluate(node)

    def evaluate(self, node) -> Series:
        if isinstance(node, Const):
            raise QueryError("incorrect query type")
        if isinstance(node, Ref):
            return self.read(node.text)
        f, lazy = catalogue._function(node.name)
        args = node.args if lazy else [self.argument(a) for a in node.args]
        _check(node.name, f, args)
        out = f(self, node, *args)
        out.hinted = out.hinted or node.name in HINTS or any(getattr(a, "hinted", False) for a in args)
        return out


#: Functions that set the option xFilesFactor.
HINTS = ("setXFilesFactor", "xFilesFactor")
#: Parameters of functions that take a series.
SETS = ("s", "a", "b", "w", "divisor")


def _check(name: str, f, args) -> None:
    """Number and kinds of arguments; a defect inside a function is not taken for a wrong query."""
    try:
        given = inspect.signature(f).bind(None, None, *args).arguments
    except TypeError as e:
        raise QueryError(f"{name}: {e}") from e
    for k, v in given.items():
        if k in SETS and not isinstance(v, Series):
            raise QueryError(f"{name}: a series is needed, not {v!r}")
        if k not in SETS and k not in ("args", "total", "reference", "ctx", "call") and isinstance(v, Series):
            raise QueryError(f"{name}: a constant is needed for {k}")


def evaluate(store, target: str, start: int, end: int, now: int, default_step: int = 60) -> Series:
    """Series of one target over [start, end)."""
    return Context(store, start, end, now, default_step).evaluate(parse(target))


def render(store, targets: list[str], start: int, end: int, now: int, default_step: int = 60, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, name, ts, value) and (query, error) of all targets; a wrong target has an error and no rows.

    ``most``: the largest number of points a series; see ``consolidated``.
    """
    ctx, out, errors = Context(store, start, end, now, default_step), None, []
    for t in targets:
        try:
            s = ctx.evaluate(parse(t))
            rows = (consolidated(s, most) if most else s).result().select(F.lit(t).alias("query"), "name", "ts", "value")
        except (QueryError, ValueError) as e:
            errors.append((t, str(e)))
            continue
        errors.append((t, ""))
        out = rows if out is None else out.unionByName(rows)
    spark = store.spark
    if out is None:
        out = spark.createDataFrame([], "query string, name string, ts bigint, value double")
    return out, spark.createDataFrame(errors, "query string, error string")


__all__ = ["Call", "Context", "evaluate", "render"]
