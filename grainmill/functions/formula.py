"""A spreadsheet formula language, compiled to Spark columns.

Loosest to tightest: OR, AND, comparison and IN, ``+ - &``, ``* /``, unary ``-`` and
NOT.  Columns are ``@name`` or ``@[any name]``; texts stand in double quotes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank


class FormulaError(ValueError):
    """A formula that can't be read or compiled; ``position`` is a character, or -1."""

    def __init__(self, message: str, position: int = -1):
        super().__init__(message)
        self.position = position


@dataclass(frozen=True)
class Node:
    kind: str  # number, text, boolean, column, call, binary, unary, in
    value: Any
    parts: tuple[Node, ...] = ()


TOKEN = re.compile(r'\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>"[^"]*")|@\[(?P<quoted>[^\]]+)\]|@(?P<column>[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<sign><=|>=|<>|!=|[-+*/&=<>(),]))')


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected character at {at}", at)
        kind = m.lastgroup
        value = m.group(kind)
        out.append(("column" if kind == "quoted" else kind, value, m.start(kind)))
        at = m.end()
    return [*out, ("end", "", len(source))]


class Parser:
    def __init__(self, source: str):
        body = source.strip()
        self.items, self.at = tokens(body[1:] if body.startswith("=") else body), 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        kind, value, _ = self.items[min(self.at + ahead, len(self.items) - 1)]
        return kind in ("sign", "name") and value.upper() in values

    def take(self) -> tuple[str, str, int]:
        item = self.items[self.at]
        self.at += 1
        return item

    def expect(self, value: str) -> None:
        if not self.peek(value):
            raise FormulaError(f"expected {value} at {self.items[self.at][2]}", self.items[self.at][2])
        self.at += 1

    def whole(self) -> Node:
        node = self.disjunction()
        if self.items[self.at][0] != "end":
            raise FormulaError(f"unexpected {self.items[self.at][1]!r} at {self.items[self.at][2]}", self.items[self.at][2])
        return node

    def chain(self, below: Callable[[], Node], *signs: str) -> Node:
        node = below()
        while self.peek(*signs):
            node = Node("binary", self.take()[1].upper(), (node, below()))
        return node

    def disjunction(self) -> Node:
        return self.chain(self.conjunction, "OR")

    def conjunction(self) -> Node:
        return self.chain(self.comparison, "AND")

    def comparison(self) -> Node:
        node = self.sum()
        if self.peek("=", "<>", "!=", "<", ">", "<=", ">="):
            return Node("binary", self.take()[1], (node, self.sum()))
        negated = self.peek("NOT") and self.peek("IN", ahead=1)
        if negated or self.peek("IN"):
            self.at += 1 + negated
            return Node("in", negated, (node, *self.arguments()))
        return node

    def sum(self) -> Node:
        return self.chain(self.product, "+", "-", "&")

    def product(self) -> Node:
        return self.chain(self.unary, "*", "/")

    def unary(self) -> Node:
        if self.peek("-", "NOT"):
            return Node("unary", self.take()[1].upper(), (self.unary(),))
        return self.primary()

    def arguments(self) -> tuple[Node, ...]:
        self.expect("(")
        parts = []
        if not self.peek(")"):
            parts.append(self.disjunction())
            while self.peek(","):
                self.at += 1
                parts.append(self.disjunction())
        self.expect(")")
        return tuple(parts)

    def primary(self) -> Node:
        kind, value, position = self.take()
        if kind == "number":
            return Node("number", float(value) if "." in value else int(value))
        if kind == "text":
            return Node("text", value[1:-1])
        if kind == "column":
            return Node("column", value.strip())
        if kind == "sign" and value == "(":
            node = self.disjunction()
            self.expect(")")
            return node
        if kind == "name":
            if value.upper() in ("TRUE", "FALSE") and not self.peek("("):
                return Node("boolean", value.upper() == "TRUE")
            if self.peek("("):
                return Node("call", value.upper(), self.arguments())
        raise FormulaError(f"unexpected {value or 'end'!r} at {position}", position)


def parse(source: str) -> Node:
    if not source.strip().lstrip("=").strip():
        raise FormulaError("the formula is empty", 0)
    return Parser(source).whole()


def columns_of(node: Node) -> list[str]:
    """Columns in the order they first stand."""
    found = [node.value] if node.kind == "column" else []
    for p in node.parts:
        found += columns_of(p)
    return list(dict.fromkeys(found))


def _s(c: Column) -> Column:
    return c.cast("string")


def _n(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _count(c: Column) -> Column:
    return c.cast("string").try_cast("int")


def _d(c: Column) -> Column:
    return c.try_cast("date")


def _left(c: Column, n: Column) -> Column:
    s, k = _s(c), _count(n)
    return F.when(k < 0, F.left(s, F.greatest(F.length(s) + k, F.lit(0)))).otherwise(F.left(s, k))


def _right(c: Column, n: Column) -> Column:
    s, k = _s(c), _count(n)
    return F.when(k < 0, F.right(s, F.greatest(F.length(s) + k, F.lit(0)))).otherwise(F.right(s, k))


def _mid(c: Column, start: Column, size: Column) -> Column:
    s, at, n = _s(c), _count(start), _count(size)
    return F.when(at == 0, F.substring(s, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.substring(s, at, n))


def _split(c: Column, sign: Column, n: Column) -> Column:
    k = _count(n)
    return F.when(k == 0, F.lit("")).otherwise(F.split_part(_s(c), _s(sign), F.when(k == 0, F.lit(1)).otherwise(k)))


def _back(pattern: Column, to: Column) -> Column:
    return F.regexp_replace(F.replace(_s(to), F.lit("$"), F.lit("\\$")), r"\\([0-9])", r"\$$1")


def _power(a: Column, b: Column) -> Column:
    return F.pow(_n(a), _n(b))


def _all(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def _any(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


#: name: (least arguments, most or None, function, result kind)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column], str]] = {
    "LEN": (1, 1, lambda c: F.length(_s(c)), "number"),
    "UPPER": (1, 1, lambda c: F.upper(_s(c)), "text"),
    "LOWER": (1, 1, lambda c: F.lower(_s(c)), "text"),
    "TRIM": (1, 1, lambda c: F.trim(_s(c)), "text"),
    "LEFT": (2, 2, _left, "text"),
    "RIGHT": (2, 2, _right, "text"),
    "MID": (3, 3, _mid, "text"),
    "CONCAT": (1, None, lambda *cs: F.concat_ws("", *map(_s, cs)), "text"),
    "SUBSTITUTE": (3, 3, lambda c, a, b: F.replace(_s(c), _s(a), _s(b)), "text"),
    "PROPER": (1, 1, lambda c: F.initcap(_s(c)), "text"),
    "SPLIT": (3, 3, _split, "text"),
    "LPAD": (3, 3, lambda c, n, p: F.lpad(_s(c), _count(n), _s(p)), "text"),
    "ROUND": (1, 2, lambda c, n=None: F.round(_n(c)) if n is None else F.round(_n(c) * F.pow(F.lit(10.0), _n(n))) / F.pow(F.lit(10.0), _n(n)), "number"),
    "ABS": (1, 1, lambda c: F.abs(_n(c)), "number"),
    "CEILING": (1, 1, lambda c: F.ceil(_n(c)).cast("double"), "number"),
    "FLOOR": (1, 1, lambda c: F.floor(_n(c)).cast("double"), "number"),
    "SQRT": (1, 1, lambda c: F.sqrt(_n(c)), "number"),
    "POWER": (2, 2, _power, "number"),
    "MOD": (2, 2, lambda a, b: F.try_mod(_n(a), _n(b)), "number"),
    "AND": (2, None, _all, "boolean"),
    "OR": (2, None, _any, "boolean"),
    "NOT": (1, 1, lambda c: ~c, "boolean"),
    "ISBLANK": (1, 1, is_blank, "boolean"),
    "CONTAINS": (2, 2, lambda c, x: F.contains(_s(c), _s(x)), "boolean"),
    "ICONTAINS": (2, 2, lambda c, x: F.contains(F.lower(_s(c)), F.lower(_s(x))), "boolean"),
    "STARTSWITH": (2, 2, lambda c, x: F.startswith(_s(c), _s(x)), "boolean"),
    "ENDSWITH": (2, 2, lambda c, x: F.endswith(_s(c), _s(x)), "boolean"),
    "LIKE": (2, 2, lambda c, x: F.like(_s(c), F.replace(_s(x), F.lit("\\"), F.lit("\\\\"))), "boolean"),
    "ILIKE": (2, 2, lambda c, x: F.ilike(_s(c), F.replace(_s(x), F.lit("\\"), F.lit("\\\\"))), "boolean"),
    "REGEX": (2, 2, lambda c, x: F.regexp_like(_s(c), _s(x)), "boolean"),
    "REGEXEXTRACT": (2, 2, lambda c, x: F.coalesce(F.regexp_substr(_s(c), _s(x)), F.when(c.isNotNull(), F.lit(""))), "text"),
    "REGEXREPLACE": (3, 3, lambda c, x, to: F.regexp_replace(_s(c), _s(x), _back(x, to)), "text"),
    "BETWEEN": (3, 3, lambda c, a, b: c.between(a, b), "boolean"),
    "YEAR": (1, 1, lambda c: F.year(_d(c)), "number"),
    "MONTH": (1, 1, lambda c: F.month(_d(c)), "number"),
    "DAY": (1, 1, lambda c: F.day(_d(c)), "number"),
    "DATEDIFF": (2, 2, lambda a, b: F.datediff(_d(b), _d(a)), "number"),
    "IF": (3, 3, lambda *_: F.lit(None), "any"),
    "IFERROR": (2, 2, lambda *_: F.lit(None), "any"),
    "COALESCE": (2, None, lambda *cs: F.coalesce(*cs), "any"),
}


def kind_of(node: Node) -> str:
    """text, number, boolean, or any where only the data can tell."""
    if node.kind in ("number", "text", "boolean"):
        return node.kind
    if node.kind == "call" and node.value in FUNCTIONS:
        if node.value in ("IF", "IFERROR", "COALESCE"):
            return common_kind([kind_of(p) for p in (node.parts[1:] if node.value == "IF" else node.parts)])
        return FUNCTIONS[node.value][3]
    if node.kind == "binary":
        return {"&": "text", "+": "number", "-": "number", "*": "number", "/": "number"}.get(node.value, "boolean")
    if node.kind == "unary":
        return "number" if node.value == "-" else "boolean"
    return "boolean" if node.kind == "in" else "any"


def common_kind(kinds: list[str]) -> str:
    known = {k for k in kinds if k != "any"}
    if not known:
        return "any"
    return known.pop() if len(known) == 1 and "any" not in kinds else ("any" if "any" in kinds and len(known) <= 1 else "text")


def _alike(nodes: list[Node], columns: list[Column]) -> list[Column]:
    """Branches as text where one is text or kinds differ, as numbers where all are."""
    kinds = [kind_of(n) for n in nodes]
    if "text" in kinds or len({k for k in kinds if k != "any"}) > 1:
        return [_s(c) for c in columns]
    if set(kinds) == {"number"}:
        return [c.cast("double") for c in columns]
    return columns


def compile_formula(source: str, available: list[str]) -> Column:
    """The formula as one column expression over ``available`` columns."""
    return _compile(parse(source), available)


def _number(node: Node, c: Column) -> Column:
    return c if kind_of(node) == "number" else _n(c)


def _compile(node: Node, available: list[str]) -> Column:
    if node.kind in ("number", "text", "boolean"):
        return F.lit(node.value)
    if node.kind == "column":
        if node.value not in available:
            raise FormulaError(f"unknown column: {node.value}")
        return F.col("`" + node.value.replace("`", "``") + "`")
    parts = [_compile(p, available) for p in node.parts]
    if node.kind == "unary":
        return -_number(node.parts[0], parts[0]) if node.value == "-" else ~parts[0]
    if node.kind == "in":
        first, *rest = parts
        if any(kind_of(p) == "text" for p in node.parts[1:]):
            first, rest = _s(first), [_s(r) for r in rest]
        found = first.isin(*rest)
        return ~found if node.value else found
    if node.kind == "binary":
        return _binary(node, *parts)
    if node.value not in FUNCTIONS:
        raise FormulaError(f"unknown function: {node.value}")
    least, most, function, _ = FUNCTIONS[node.value]
    if len(parts) < least or (most is not None and len(parts) > most):
        raise FormulaError(f"{node.value} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(parts)}")
    if node.value == "IF":
        yes, no = _alike(list(node.parts[1:]), parts[1:])
        return F.when(parts[0], yes).otherwise(no)
    if node.value in ("IFERROR", "COALESCE"):
        # every operation compiles to its try_ form, so that an error is a null here
        return F.coalesce(*_alike(list(node.parts), parts))
    return function(*parts)


def _binary(node: Node, a: Column, b: Column) -> Column:
    left, right = node.parts
    sign = node.value
    if sign in ("AND", "OR"):
        return a & b if sign == "AND" else a | b
    if sign == "&":
        return F.concat_ws("", _s(a), _s(b))
    if sign in "+-*/":
        x, y = _number(left, a), _number(right, b)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[sign]()
    kinds = {kind_of(left), kind_of(right)}
    if "text" in kinds and kinds != {"text"}:
        a, b = _s(a), _s(b)
    elif kinds == {"any", "number"}:
        a, b = _number(left, a), _number(right, b)
    return {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]
