"""VertexCreator: points from columns, and vertices added to, inserted in or replaced in points, lines and rings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import Value, col
from geoloom.layer import Layer, known_crs, layer

MODES = ("Replace with Point", "Add Point", "Insert at Index", "Replace at Index")
Z_CONFLICTS = ("None (Drop Values)", "Compute", "Custom Value")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def vertex(
    l: Layer, mode: str, x: Value, y: Value, z: Value | None = None, index: Value | None = None, crs: str | None = None, remove_attributes: bool = False,
    z_conflict: str = "Compute", z_custom: float = 0.0, ignore_duplicates: bool = True, closed_lines: str = "Create Polygon",
) -> dict[str, Layer]:
    """``output`` and ``rejected``, whose rows keep their attributes and say why in ``rejection_code``.

    A row is rejected, for the first reason that holds, as MISSING_COORDINATE, MISSING_INDEX, UNSUPPORTED_GEOMETRY_TYPE
    (not null, point or line; with an index polygons pass too) or POLYGON_WITH_HOLES. Indexes count from 0, negative
    ones from the end, and those beyond an end mean that end. Adding a vertex that is the last already changes nothing
    while duplicates are ignored. A closed line of four or more vertices becomes a polygon unless
    ``closed_lines="Create Line"``. If only the shape or the new vertex has a height, ``z_conflict`` drops it, computes
    the other (the last vertex's, or by distance between the neighbours) or takes ``z_custom``.
    """
    if mode not in MODES or z_conflict not in Z_CONFLICTS:
        raise ValueError(f"unknown mode: {mode} / {z_conflict}")
    specs = [v for v in (x, y, z, index) if v is not None]
    if not x.filled or not y.filled or (mode.endswith("Index") and (index is None or not index.filled)):
        raise ValueError("a coordinate or index isn't filled in")
    g = l.geometry or "geometry"
    new = F.struct(*[(v.column().try_cast("double") if v is not None and v.filled else F.lit(None).cast("double")).alias(n) for n, v in (("x", x), ("y", y), ("z", z))])
    gone = {v.args[0] for v in specs if v.kind == "attribute"} if remove_attributes and mode == "Replace with Point" else set()
    df = l.df.select("*", new.alias("_new"), (index.column().try_cast("bigint") if index is not None and mode.endswith("Index") else F.lit(0).cast("bigint")).alias("_i"))
    code = F.when(F.col("_new.x").isNull() | F.col("_new.y").isNull(), "MISSING_COORDINATE").when(F.col("_i").isNull(), "MISSING_INDEX")
    if mode != "Replace with Point" and l.geometry:
        kind = geo.st_geometrytype(col(g))
        fine = ["POINT", "LINESTRING", *(["POLYGON"] if mode.endswith("Index") else [])]
        code = code.when(kind.isNotNull() & ~kind.isin(*fine), "UNSUPPORTED_GEOMETRY_TYPE").when((kind == "POLYGON") & (geo.st_measure("holes", col(g)) > 0), "POLYGON_WITH_HOLES")
    df = df.withColumn("rejection_code", code)
    rest = [col(c) for c in l.columns if c != g and c not in gone]
    good = df.where("rejection_code IS NULL")
    if mode == "Replace with Point" or not l.geometry:
        shape = geo.st_point(F.col("_new.x"), F.col("_new.y"), F.col("_new.z"))
    else:
        polygon = F.coalesce(geo.st_geometrytype(col(g)) == "POLYGON", F.lit(False))
        all_ = _let(F.coalesce(geo.st_vertices(col(g)), F.array().cast("array<struct<x:double,y:double,z:double>>")), lambda v: _edited(v, F.col("_new"), F.col("_i"), mode, z_conflict, z_custom, ignore_duplicates, polygon))
        ring = F.lit(closed_lines != "Create Line")
        shape = _let(all_, lambda v: geo.st_from_vertices(v, polygon | (ring & (F.size(v) >= 4) & (v[0]["x"] == F.element_at(v, -1)["x"]) & (v[0]["y"] == F.element_at(v, -1)["y"]))))
    out = layer(good.select(*rest, shape.alias(g)), g, known_crs(crs) if crs else l.crs)
    bad = df.where("rejection_code IS NOT NULL").select(*[col(c) for c in l.columns], "rejection_code")
    return {"output": out, "rejected": l.with_df(bad)}


def _edited(v: Column, new: Column, i: Column, mode: str, conflict: str, custom: float, ignore: bool, polygon: Column) -> Column:
    n = F.size(v)
    high = F.exists(v, lambda p: p["z"].isNotNull())
    given = new["z"].isNotNull()
    three = (given & high) if conflict.startswith("None") else (given | high)
    last = F.when(n > 0, F.element_at(v, F.greatest(n, F.lit(1))))
    if mode == "Add Point":
        place = n + 1
        guess = last["z"] if conflict == "Compute" else F.lit(custom)
        same = (last["x"] == new["x"]) & (last["y"] == new["y"])
        start = v[0] if mode else None
        ends = F.when(same, last["z"]).when((n > 0) & (start["x"] == new["x"]) & (start["y"] == new["y"]), start["z"])
        guess = F.coalesce(ends, guess)
    else:
        top = n if mode == "Insert at Index" else n - 1
        back = n + 1 + i if mode == "Insert at Index" else n + i
        place = F.greatest(F.when(i >= 0, F.least(i, top)).otherwise(F.greatest(back, F.lit(0))), F.lit(0)) + 1
        after = place if mode == "Insert at Index" else place + 1
        a, b = F.get(v, (place - 2).cast("int")), F.get(v, (after - 1).cast("int"))
        far = lambda p: F.sqrt(F.pow(p["x"] - new["x"], 2) + F.pow(p["y"] - new["y"], 2))
        between = F.when(far(a) + far(b) > 0, a["z"] + (b["z"] - a["z"]) * far(a) / (far(a) + far(b))).otherwise((a["z"] + b["z"]) / 2)
        guess = F.coalesce(between, a["z"], b["z"]) if conflict == "Compute" else F.lit(custom)
    nz = F.when(three, F.coalesce(new["z"], F.when(high, guess), F.lit(0.0)))
    put = F.struct(new["x"].alias("x"), new["y"].alias("y"), nz.alias("z"))
    fill = F.coalesce(nz, F.lit(0.0)) if conflict == "Compute" else F.lit(custom)
    old = F.transform(v, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(three, F.coalesce(p["z"], fill)).alias("z")))
    place = place.cast("int")
    if mode == "Replace at Index":
        out = F.concat(F.slice(old, 1, F.greatest(place - 1, F.lit(0))), F.array(put), F.slice(old, place + 1, F.greatest(n - place, F.lit(0))))
        return F.when(n == 0, F.array(put)).otherwise(out)
    out = F.concat(F.slice(old, 1, F.greatest(place - 1, F.lit(0))), F.array(put), F.slice(old, place, F.greatest(n - place + 1, F.lit(0))))
    if mode == "Add Point" and ignore:
        return F.when(F.coalesce((last["x"] == new["x"]) & (last["y"] == new["y"]), F.lit(False)), old).otherwise(out)
    return out
