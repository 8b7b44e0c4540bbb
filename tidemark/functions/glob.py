"""Glob patterns over dotted names, compiled to regular expressions.

``*`` stays within a component and ``**`` crosses dots; both need a character at the end
of the pattern.  ``[abc]`` is a literal set.  ``{a,bc}`` takes the longest alternative
that fits and never goes back to a shorter one (an atomic group); empty alternatives do
not count unless ``empty_alternatives`` is set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"^[A-Za-z0-9_:@#=-]+(\.[A-Za-z0-9_:@#=-]+)*$"


class PatternError(ValueError):
    """A group or set of a pattern is not closed."""


def is_pattern(text: str) -> bool:
    return any(c in "[]{}*" for c in text)


def is_basename(text: str) -> bool:
    return "." not in text and "**" not in text


def is_indeterminate(text: str) -> bool:
    return "**" in text


def is_valid_key(key: str) -> bool:
    return re.fullmatch(KEY, key) is not None


def regex(pattern: str, empty_alternatives: bool = False) -> str:
    """A regular expression (Java and Python) that matches whole names."""
    out, i, n = [], 0, len(pattern)
    quote = lambda s: re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)
    while i < n:
        c = pattern[i]
        if c == "*":
            wide = pattern[i : i + 2] == "**"
            i += 2 if wide else 1
            out.append(("." if wide else "[^.]") + ("+" if i >= n else "*"))
        elif c in "[{":
            end = pattern.find("]" if c == "[" else "}", i)
            if end < 0:
                raise PatternError(f"unterminated {c!r} in {pattern!r}")
            body = pattern[i + 1 : end]
            i = end + 1
            if c == "[":
                out.append(f"[{quote(body)}]" if body else "(?!)")
            else:
                parts = sorted({p for p in body.split(",") if p or empty_alternatives}, key=lambda p: (-len(p), p))
                out.append("(?>" + "|".join(map(quote, parts)) + ")" if parts else "(?!)")
        else:
            out.append(quote(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches(name: str, pattern: str, **how) -> bool:
    return re.search(regex(pattern, **how), name) is not None


def literal_prefix(pattern: str) -> str:
    """What every match begins with."""
    return re.split(r"[\[\]{}*]", pattern, maxsplit=1)[0]


def condition(name: Column, pattern: str, **how) -> Column:
    """Whether a name column matches; the literal prefix lets a sorted scan skip row groups."""
    if not is_pattern(pattern):
        return name == pattern
    prefix, match = literal_prefix(pattern), name.rlike(regex(pattern, **how))
    return name.startswith(prefix) & match if prefix else match
