"""Routing: operators with several output ports. Every port is a lazy layer over one shared plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.functions.values import Condition, col, comparison, literal, predicate
from geoloom.layer import Layer, need_columns, need_geometry

MOST_PORTS = 40


def tester(layer: Layer, conditions: Sequence[Condition], logic: str = "AND") -> dict[str, Layer]:
    """``passed`` and ``failed``: a test that is null fails, so that no row is lost; without a test all pass."""
    p = predicate(layer.df, list(conditions), logic)
    p = F.lit(True) if p is None else p
    return {"passed": layer.with_df(layer.df.where(p)), "failed": layer.with_df(layer.df.where(~p))}


def test_filter(layer: Layer, rules: Sequence[Condition]) -> dict[str, Layer]:
    """``r0`` to ``rn`` and ``unfiltered``: a row goes to the first rule that it meets; an unfilled rule gets none."""
    if len(rules) > MOST_PORTS:
        raise ValueError(f"at most {MOST_PORTS} rules")
    port: Column = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        r = rules[k]
        if r.filled:
            port = F.when(F.coalesce(comparison(layer.df, r.column, r.operator, r.value), F.lit(False)), F.lit(k)).otherwise(port)
    out = {f"r{k}": layer.with_df(layer.df.where(F.coalesce(port == k, F.lit(False)))) for k in range(len(rules))}
    return out | {"unfiltered": layer.with_df(layer.df.where(port.isNull()))}


def attribute_filter(layer: Layer, column: str | None, values: Sequence[Any]) -> dict[str, Layer]:
    """``v0`` to ``vn`` and ``unfiltered``: one port for each value; nulls and other values are unfiltered."""
    if len(values) > MOST_PORTS:
        raise ValueError(f"at most {MOST_PORTS} values")
    if not column:
        return {f"v{k}": layer.with_df(layer.df.where(F.lit(False))) for k in range(len(values))} | {"unfiltered": layer}
    need_columns(layer.df, [column])
    kind = layer.df.schema[column].dataType
    lits = [F.lit(literal(v, kind)).cast(kind) for v in values]
    out = {f"v{k}": layer.with_df(layer.df.where(col(column) == v)) for k, v in enumerate(lits)}
    rest = col(column).isNull() | ~col(column).isin(*lits) if lits else F.lit(True)
    return out | {"unfiltered": layer.with_df(layer.df.where(rest))}


def duplicate_filter(layer: Layer, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> dict[str, Layer]:
    """``unique``, one row for each key, and ``duplicate``, the others; nulls are one key. Without keys all are unique.

    ``order`` says which row is the first of its key; without it the hash of the whole row does. Rows are written with
    numbers, so that both ports agree; only keys, orders and numbers are shuffled, and of each key no more than its first row
    from each task, so that a key with most of the rows weighs no more than others. The ports take rows by their numbers.
    """
    if not keys:
        return {"unique": layer, "duplicate": layer.with_df(layer.df.where(F.lit(False)))}
    need_columns(layer.df, list(keys))
    order = order or [F.xxhash64(*map(col, layer.columns))]
    rows = written(layer.df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    first = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*order, "_row"))
    heads = written(rows.withColumn("_n", first).where("_n = 1").select("_row"), "heads")
    port = lambda how: layer.with_df(rows.join(heads, "_row", how).select(*map(col, layer.columns)))
    return {"unique": port("left_semi"), "duplicate": port("left_anti")}


def eliminate_coincident_points(layer: Layer, tolerance: float = 1e-5, order: Sequence[Column | str] | None = None) -> Layer:
    """One point for each square of the grid with this spacing; rows without a point are one square."""
    if not tolerance > 0:
        raise ValueError("the tolerance must be above 0")
    g = col(need_geometry(layer))
    by = [F.round(f(g) / tolerance) for f in (geo.st_x, geo.st_y)]
    order = order or [F.xxhash64(*map(col, layer.columns))]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return layer.with_df(layer.df.withColumn("_n", first).where("_n = 1").drop("_n"))


def filter_by_area(layer: Layer, min: float | None = 0, max: float | None = None) -> dict[str, Layer]:
    """``kept`` and ``removed`` by area in hectares, bounds included; a blank maximum is none.

    A row without geometry has no area and goes to neither port.
    """
    try:
        low, high = float(min or 0), None if max in (None, "") else float(max)
    except ValueError:
        raise ValueError("the bounds must be numbers") from None
    area = geo.st_area(geo.st_transform(col(need_geometry(layer)), layer.crs, "EPSG:6933")) / 10_000
    inside = (area >= low) & (area <= high) if high is not None else area >= low
    return {"kept": layer.with_df(layer.df.where(inside)), "removed": layer.with_df(layer.df.where(~inside))}
