"""Durations, relative times and retention lists.  ``now`` is always a parameter."""

from __future__ import annotations

import re

#: Seconds of each unit letter (fixed values).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
#: Words for units as they occur in interval strings such as '1hour' or '10min'.
WORDS = {
    "sec": "s", "secs": "s", "second": "s", "seconds": "s", "min": "m", "mins": "m", "minute": "m", "minutes": "m",
    "hour": "h", "hours": "h", "day": "d", "days": "d", "week": "w", "weeks": "w", "year": "y", "years": "y",
}
#: Aggregation methods by number (fixed values).
METHODS = {1: "average", 2: "sum", 3: "last", 4: "min", 5: "max"}


def duration(text: str, default_unit: int = 1) -> int:
    """Seconds of ``[-]digits[ywdhms]``; digits alone are multiplied by ``default_unit``."""
    m = re.fullmatch(r"\s*([-+]?)(\d+)\s*([A-Za-z]*)\s*", text)
    if not m:
        raise ValueError(f"invalid time length: {text!r}")
    sign, digits, unit = m.groups()
    unit = WORDS.get(unit.lower(), unit)
    if unit and unit not in UNITS:
        raise ValueError(f"invalid time unit: {text!r}")
    n = int(digits) * (UNITS[unit] if unit else default_unit)
    return -n if sign == "-" else n


def relative_time(text: str | int, now: int) -> int:
    """Epoch seconds of ``now``, an absolute integer (0x and leading-0 octal too), or a signed duration before or after now."""
    if isinstance(text, int):
        return text
    t = text.strip()
    if t in ("", "now"):
        return now
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", t):
        return int(t, 16)
    if re.fullmatch(r"\d+", t):
        return int(t, 8) if len(t) > 1 and t[0] == "0" and not set(t) & set("89") else int(t)
    if t[0] in "+-" and t[1:2].isdigit():
        return now + duration(t[1:]) * (1 if t[0] == "+" else -1)
    raise ValueError(f"invalid time: {text!r}")


def archives(text: str) -> list[tuple[int, int]]:
    """[(seconds per point, points)] of ``precision:points,...``; points may be a duration."""
    out = []
    for part in text.split(","):
        p, sep, n = part.strip().partition(":")
        if not sep:
            raise ValueError(f"invalid archive: {part!r}")
        precision = duration(p)
        points = int(n) if n.isdigit() else (duration(n) // precision if precision > 0 else 0)
        out.append((precision, points))
    check_archives(out)
    return out


def check_archives(a: list[tuple[int, int]]) -> None:
    """Raise ValueError unless the list is a valid set of tiers, finest first."""
    if not a:
        raise ValueError("no archives")
    for k, (step, n) in enumerate(a):
        if step <= 0 or n <= 0:
            raise ValueError("precision and points must be positive")
        if not k:
            continue
        before, m = a[k - 1]
        if step <= before:
            raise ValueError("archives must go from finer to coarser")
        if step % before:
            raise ValueError("a precision must be a multiple of the finer one")
        if step * n <= before * m:
            raise ValueError("a coarser archive must cover more time")
        if m < step // before:
            raise ValueError("a finer archive has too few points for one coarser point")


def xff(x: float) -> float:
    """Fraction of known points that a roll-up needs; outside [0, 1] it becomes 0."""
    return x if 0 <= x <= 1 else 0.0
