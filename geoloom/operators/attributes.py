"""Attributes: keep, remove, rename, create, edit, and SQL over a layer."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from geoloom.functions.values import Value, col
from geoloom.layer import Layer, known_crs, need_columns

#: What an attribute can be converted to, and the Spark type of each.
CONVERSIONS = {"Text": "string", "Integer": "bigint", "Decimal": "double", "Boolean": "boolean", "Date": "date", "Date and time": "timestamp_ntz"}


def keep(layer: Layer, columns: Sequence[str]) -> Layer:
    """Only the listed columns, in the order given; without any, all."""
    if not columns:
        return layer
    need_columns(layer.df, list(columns))
    return layer.with_df(layer.df.select(*map(col, columns)))


def remove(layer: Layer, columns: Sequence[str]) -> Layer:
    """All but the listed columns, which must exist."""
    need_columns(layer.df, list(columns))
    return layer.with_df(layer.df.drop(*columns))


def rename(layer: Layer, renames: dict[str, str] | Sequence[tuple[str, str]]) -> Layer:
    """New names in place, all at once, so that two columns can swap names; half-filled renames are left out."""
    pairs = dict(p for p in (renames.items() if isinstance(renames, dict) else renames) if p[0] and p[1])
    need_columns(layer.df, list(pairs))
    df = layer.df.select(*[col(c).alias(pairs.get(c, c)) for c in layer.columns])
    return replace(layer, df=df, geometry=pairs.get(layer.geometry, layer.geometry))


def create(layer: Layer, creates: Sequence[tuple[str, Value]]) -> Layer:
    """Append columns, all computed from the input; unnamed and unfilled ones are left out."""
    new = [v.column().alias(name) for name, v in creates if name and v.filled]
    return layer.with_df(layer.df.select("*", *new))


def transform_sql(layer: Layer, sql: str) -> Layer:
    """Any one SELECT over the table ``input``, with common table expressions if wanted; blank SQL changes nothing."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        return layer
    if ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "", text):
        raise ValueError("one statement is wanted")
    if not re.match(r"(?is)(with|select|values|from|table|\()", text):
        raise ValueError("only queries are allowed")
    view = f"input_{uuid.uuid4().hex}"
    layer.df.createOrReplaceTempView(view)
    # ``input`` is a common table expression before the user's own, so that theirs can refer to it.
    if m := re.match(r"(?is)with\s+(recursive\s+)?", text):
        text = f"WITH {m[1] or ''}input AS (SELECT * FROM {view}), {text[m.end() :]}"
    else:
        text = f"WITH input AS (SELECT * FROM {view}) {text}"
    spark = layer.df.sparkSession
    try:
        return layer.with_df(spark.sql(text))
    finally:
        spark.catalog.dropTempView(view)


def create_sql(layer: Layer, sql: str) -> Layer:
    """As ``transform_sql``, but the query must add at least one column."""
    out = transform_sql(layer, sql)
    if sql.strip() and not set(out.columns) - set(layer.columns):
        raise ValueError("the query adds no attribute")
    return out


@dataclass(frozen=True)
class SetValue:
    column: str
    value: Value


@dataclass(frozen=True)
class Rename:
    column: str
    to: str


@dataclass(frozen=True)
class CopyTo:
    column: str
    to: str


@dataclass(frozen=True)
class Create:
    to: str
    value: Value


@dataclass(frozen=True)
class Convert:
    column: str
    to: str


@dataclass(frozen=True)
class Remove:
    column: str


def edit(layer: Layer, actions: Sequence) -> Layer:
    """Edits in order, each over the result of those before; unfilled ones and unknown columns are skipped.

    Set and converted values keep the column's place. A value that doesn't convert becomes null.
    """
    df, geometry = layer.df, layer.geometry
    for a in actions:
        name = getattr(a, "column", None)
        if name is not None and name not in df.columns:
            continue
        if isinstance(a, SetValue) and a.value.filled:
            df = _with(df, name, a.value.column())
        elif isinstance(a, Rename) and a.to:
            df = df.select(*[col(c).alias(a.to if c == name else c) for c in df.columns])
            geometry = a.to if geometry == name else geometry
        elif isinstance(a, CopyTo) and a.to:
            df = df.select("*", col(name).alias(a.to))
        elif isinstance(a, Create) and a.to and a.value.filled:
            df = df.select("*", a.value.column().alias(a.to))
        elif isinstance(a, Convert) and a.to in CONVERSIONS:
            df = _with(df, name, converted(col(name), a.to))
        elif isinstance(a, Remove):
            df = df.drop(name)
    return replace(layer, df=df, geometry=geometry).with_df(df)


def converted(c: Column, to: str) -> Column:
    """A cast that gives null where it fails. Text with a fraction rounds to an integer, as numbers do."""
    return c.try_cast(CONVERSIONS[to])


def _with(df: DataFrame, name: str, c: Column) -> DataFrame:
    return df.select(*[c.alias(name) if n == name else col(n) for n in df.columns])


def set_crs(layer: Layer, crs: str) -> Layer:
    """Relabel the layer; no coordinate changes."""
    return replace(layer, crs=known_crs(crs))


