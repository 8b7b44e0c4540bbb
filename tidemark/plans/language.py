"""Query texts: tokens, grammar and syntax tree.

    query := NAME | INTEGER | FLOAT | STRING | NAME '(' query (',' query)* ')'

A NAME begins with a letter and may hold glob characters; a comma inside braces belongs
to the name.  Strings have no escapes.
"""

from __future__ import annotations

from dataclasses import dataclass


class QueryError(ValueError):
    """A query text or its evaluation is wrong."""


@dataclass(frozen=True)
class Ref:
    text: str


@dataclass(frozen=True)
class Const:
    value: int | float | str
    text: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    @property
    def text(self) -> str:
        return f"{self.name}({','.join(a.text for a in self.args)})"


_INNER = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_[]{}*.<>-")


class _Parser:
    def __init__(self, text: str):
        self.text, self.i = text, 0

    def fail(self, why: str):
        raise QueryError(f"{why} at {self.i} in {self.text!r}")

    def space(self) -> None:
        while self.i < len(self.text) and self.text[self.i].isspace():
            self.i += 1

    def peek(self) -> str:
        self.space()
        return self.text[self.i : self.i + 1]

    def query(self):
        c = self.peek()
        if c in ("'", '"') and c:
            return self.string(c)
        if c.isascii() and c.isalpha():
            return self.name()
        if c and (c.isdigit() or c in "+-."):
            return self.number()
        self.fail("invalid character" if c else "no tokens")

    def string(self, quote: str) -> Const:
        end = self.text.find(quote, self.i + 1)
        if end < 0:
            self.fail("unterminated string")
        value = self.text[self.i + 1 : end]
        self.i = end + 1
        return Const(value, quote + value + quote)

    def number(self) -> Const:
        start = self.i
        while self.i < len(self.text) and (self.text[self.i].isdigit() or self.text[self.i] in "+-.eE"):
            self.i += 1
        text = self.text[start : self.i]
        try:
            return Const(int(text), text)
        except ValueError:
            try:
                return Const(float(text), text)
            except ValueError:
                self.fail(f"invalid number {text!r}")

    def name(self):
        start, depth = self.i, 0
        while self.i < len(self.text):
            c = self.text[self.i]
            if c not in _INNER and not (c == "," and depth):
                break
            depth += (c == "{") - (c == "}")
            if depth < 0:
                self.fail("unbalanced braces")
            self.i += 1
        if depth:
            self.fail("unbalanced braces")
        text = self.text[start : self.i]
        if self.peek() != "(":
            return Ref(text)
        self.i += 1
        if self.peek() == ")":
            self.fail("no tokens")
        args = [self.query()]
        while self.peek() == ",":
            self.i += 1
            args.append(self.query())
        if self.peek() != ")":
            self.fail("expected , or )")
        self.i += 1
        return Call(text, tuple(args))


def parse(text: str):
    """Syntax tree of a whole query text."""
    p = _Parser(text)
    out = p.query()
    if p.peek():
        p.fail("argument parsing incomplete")
    return out


def references(node) -> set[str]:
    """All series references of a tree."""
    if isinstance(node, Ref):
        return {node.text}
    return set().union(*(references(a) for a in node.args)) if isinstance(node, Call) else set()
