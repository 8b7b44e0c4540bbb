"""Text protocol sources: ``key value [ts]`` lines and datagrams of many lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative(token: Column, now: Column) -> Column:
    """Epoch seconds of a time token: missing, 0 or ``now`` is now; signed durations count from now; else an integer."""
    m = lambda k: F.regexp_extract(token, r"^([-+])(\d+)([smhdwy]?)$", k)
    unit = F.element_at(F.create_map(*(F.lit(x) for k, v in {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}.items() for x in (k, v))), m(3))
    offset = m(2).try_cast("bigint") * unit * F.when(m(1) == "-", -1).otherwise(1)
    plain = token.try_cast("bigint")
    return F.when(token.isNull() | token.isin("", "0", "now"), now).when(token.rlike(r"^[-+]\d+[smhdwy]?$"), now + offset).otherwise(plain)


def parse_lines(lines: DataFrame, now: int | Column, column: str = "value") -> DataFrame:
    """key, ts, value of each well-formed line; a line splits on single spaces into two or three tokens, others are dropped.

    A value that is no number, or a time that cannot be read, drops the line too.
    """
    n = F.lit(now).cast("bigint") if isinstance(now, int) else now
    parts = F.split(F.rtrim(F.regexp_replace(F.col(column), r"[\r\n]+$", "")), " ")
    rows = lines.select(*[c for c in lines.columns if c != column], parts.alias("_p")).where(F.size("_p").isin(2, 3))
    rows = rows.withColumns({"key": F.get("_p", F.lit(0)), "_v": F.get("_p", F.lit(1)).try_cast("double"), "_t": F.get("_p", F.lit(2))})
    rows = rows.withColumn("ts", relative(F.col("_t"), n)).where("key <> '' AND _v IS NOT NULL AND ts IS NOT NULL")
    keep = [c for c in lines.columns if c != column]
    return rows.select(*keep, "key", "ts", F.col("_v").alias("value"))


def parse_datagrams(datagrams: DataFrame, now: int | Column, column: str = "value") -> DataFrame:
    """As ``parse_lines`` for datagrams that each hold many lines."""
    keep = [c for c in datagrams.columns if c != column]
    each = datagrams.select(*keep, F.explode(F.split(F.col(column).cast("string"), "\n")).alias(column))
    return parse_lines(each.where(F.col(column) != ""), now, column)
