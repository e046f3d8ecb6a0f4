"""Values and conditions that users fill in: constants, attributes, formulas, SQL, comparisons."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.layer import quoted


def col(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class Value:
    """A value for each row. ``filled`` is false where the user left something out; such values are skipped."""

    kind: str
    args: tuple = ()

    @property
    def filled(self) -> bool:
        if self.kind == "constant":
            text, kind = self.args
            return kind in ("Null", "Boolean") or (kind == "Text" and text is not None) or (kind == "Number" and _number(text) is not None)
        if self.kind == "formula":
            left, op, right = self.args
            return op in _FORMULAS and left.filled and right.filled
        return bool(self.args and self.args[0])

    def column(self) -> Column:
        if self.kind == "constant":
            text, kind = self.args
            if kind == "Null":
                return F.lit(None).cast("string")
            if kind == "Boolean":
                return F.lit(str(text).strip().lower() in ("true", "yes", "1"))
            return F.lit(_number(text)) if kind == "Number" else F.lit(str(text))
        if self.kind == "attribute":
            return col(self.args[0])
        if self.kind == "sql":
            return F.expr(self.args[0])
        left, op, right = self.args
        return _FORMULAS[op](left.column(), right.column())


#: Division by zero is null; joining text is null where either side is.
_FORMULAS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "×": lambda a, b: a * b,
    "÷": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "join text": lambda a, b: F.concat(a.cast("string"), b.cast("string")),
}


def value(const: Any, type: str = "Text") -> Value:
    """A constant of the chosen type: Text, Number, Boolean (true, yes, 1) or Null. A bad number isn't filled."""
    return Value("constant", (const, type))


def attr(name: str) -> Value:
    return Value("attribute", (name,))


def formula(left: Value, op: str, right: Value) -> Value:
    """``+ - × ÷`` or ``join text`` of two values."""
    return Value("formula", (left, {"*": "×", "/": "÷"}.get(op, op), right))


def sql(expression: str) -> Value:
    return Value("sql", (expression,))


def _number(text: Any) -> int | float | None:
    try:
        n = float(str(text).strip())
    except ValueError:
        return None
    return int(n) if n.is_integer() and abs(n) < 2**53 and "." not in str(text) and "e" not in str(text).lower() else n


COMPARISONS = ("=", "!=", ">", ">=", "<", "<=", "contains", "starts with", "is null", "is not null")


def comparison(df: DataFrame, column: str, operator: str, text: Any = None) -> Column:
    """A comparison of a column with a literal, which takes the column's type; one that doesn't convert is an error.

    ``contains`` and ``starts with`` are LIKE patterns: ``%`` and ``_`` in the value match anything.
    """
    if operator not in COMPARISONS:
        raise ValueError(f"unknown comparison: {operator}")
    c = col(column)
    if operator == "is null":
        return c.isNull()
    if operator == "is not null":
        return c.isNotNull()
    if operator == "contains":
        return c.cast("string").like(f"%{text}%")
    if operator == "starts with":
        return c.cast("string").like(f"{text}%")
    lit = F.lit(literal(text, df.schema[column].dataType)).cast(df.schema[column].dataType)
    return {"=": c == lit, "!=": c != lit, ">": c > lit, ">=": c >= lit, "<": c < lit, "<=": c <= lit}[operator]


def literal(text: Any, kind: T.DataType) -> Any:
    """A text as a value of a column's type; raises when the plan is built, not when it runs."""
    s = str(text).strip()
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}[s.lower()]
        if isinstance(kind, T.IntegralType):
            return int(s)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(s)
        if isinstance(kind, T.DecimalType):
            float(s)
            return s
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(s)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            dt.datetime.fromisoformat(s)
            return s
    except (ValueError, KeyError):
        raise ValueError(f"{text!r} can't be compared with a column of type {kind.simpleString()}") from None
    return str(text)


@dataclass(frozen=True)
class Condition:
    """One line of a test: brackets opened before and closed after it, and how it joins the line above."""

    column: str
    operator: str
    value: Any = None
    join: str | None = None
    open: int = 0
    close: int = 0

    @property
    def filled(self) -> bool:
        return bool(self.column) and self.operator in COMPARISONS and (self.operator.startswith("is ") or self.value is not None)


def predicate(df: DataFrame, conditions: list[Condition], logic: str = "AND") -> Column | None:
    """The test that the lines spell, never null; None if no line is filled in. AND binds before OR."""
    lines = [c for c in conditions if c.filled]
    if not lines:
        return None
    tokens: list[Any] = []
    for k, c in enumerate(lines):
        if k:
            tokens.append((c.join or logic).upper())
        tokens += ["("] * int(c.open) + [comparison(df, c.column, c.operator, c.value)] + [")"] * int(c.close)
    at = 0

    def joined(word: str, inner) -> Column:
        nonlocal at
        out = inner()
        while at < len(tokens) and isinstance(tokens[at], str) and tokens[at] == word:
            at += 1
            right = inner()
            out = out | right if word == "OR" else out & right
        return out

    def one() -> Column:
        nonlocal at
        if at < len(tokens) and isinstance(tokens[at], str) and tokens[at] == "(":
            at += 1
            out = either()
            if at >= len(tokens) or not isinstance(tokens[at], str) or tokens[at] != ")":
                raise ValueError("the brackets don't match")
            at += 1
            return out
        if at >= len(tokens) or isinstance(tokens[at], str):
            raise ValueError("the brackets don't match")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        return joined("OR", lambda: joined("AND", one))

    out = either()
    if at < len(tokens):
        raise ValueError("the brackets don't match")
    return F.coalesce(out, F.lit(False))
