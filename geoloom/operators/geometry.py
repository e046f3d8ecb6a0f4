"""Geometry operators. Attributes ride along; a replaced geometry becomes the last column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, is_lon_lat, known_crs, layer, need_columns, need_geometry

EQUAL_AREA = "EPSG:6933"
BUFFERS = ("azimuthal_equidistant", "individual_utm", "same_as_feature")
MEASURES = ("Area (ha)", "Perimeter (km)", "Vertices", "Geometry type", "Parts", "Centroid longitude", "Centroid latitude")


def _replaced(l: Layer, shape: Column) -> Layer:
    g = need_geometry(l)
    return l.with_df(l.df.select(*[col(c) for c in l.columns if c != g], shape.alias(g)))


def centroid(l: Layer) -> Layer:
    """The centre of mass, which may lie outside."""
    return _replaced(l, geo.st_centroid(col(need_geometry(l))))


def point_on_surface(l: Layer) -> Layer:
    """A point that is surely inside."""
    return _replaced(l, geo.st_shape("point_on_surface", col(need_geometry(l))))


def convex_hull(l: Layer, scope: str = "Each feature") -> Layer:
    """Each feature's hull, or with ``Whole layer`` one row: each task keeps the hull of what it has seen, and these meet."""
    g = col(need_geometry(l))
    if scope == "Each feature":
        return _replaced(l, geo.st_shape("convex_hull", g))
    return layer(l.df.agg(geo.st_hull_agg(g).alias(l.geometry)), l.geometry, l.crs)


def min_rectangle(l: Layer) -> Layer:
    """The rectangle of least area at any angle."""
    return _replaced(l, geo.st_shape("min_rectangle", col(need_geometry(l))))


def min_circle(l: Layer) -> Layer:
    """The least circle, as a polygon of 32 sides; of a point the point."""
    return _replaced(l, geo.st_shape("min_circle", col(need_geometry(l))))


def simplify(l: Layer, tolerance: float = 0.001) -> Layer:
    """Fewer vertices, the topology kept."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be below 0")
    return _replaced(l, geo.st_shape("simplify", col(need_geometry(l)), tolerance))


def densify(l: Layer, tolerance: float = 0.01) -> Layer:
    """Segments longer than the tolerance in floor(length / tolerance) + 1 equal parts."""
    if not tolerance > 0:
        raise ValueError("the tolerance must be above 0")
    return _replaced(l, geo.st_shape("densify", col(need_geometry(l)), tolerance))


def smooth(l: Layer, iterations: int = 2) -> Layer:
    """Corners cut at a quarter, ``iterations`` times; shapes of under four coordinates stay."""
    return _replaced(l, geo.st_shape("smooth", col(need_geometry(l)), max(0, round(iterations))))


def merge_lines(l: Layer) -> Layer:
    """Touching lines of a feature joined; other shapes stay."""
    return _replaced(l, geo.st_shape("merge_lines", col(need_geometry(l))))


def repair(l: Layer) -> Layer:
    return _replaced(l, geo.st_shape("make_valid", col(need_geometry(l))))


def bounding_box(l: Layer, mode: str = "Per feature", bounds: bool = True) -> Layer:
    """Each feature's envelope, or ``One box`` for all; with ``bounds`` also minx, miny, maxx and maxy."""
    g = need_geometry(l)
    b = geo.st_bounds(col(g))
    names = ("minx", "miny", "maxx", "maxy")
    if mode == "One box":
        df = l.df.select(b.alias("_b")).agg(*[(F.min if n[:3] == "min" else F.max)(f"_b.{n}").alias(n) for n in names])
        df = df.select(geo.st_box(*map(F.col, names)).alias(g), *names)
    else:
        df = l.df.withColumn("_b", b)
        df = df.select(*[col(c) for c in l.columns if c != g], geo.st_shape("envelope", col(g)).alias(g), *[F.col(f"_b.{n}").alias(n) for n in names])
    return layer(df if bounds else df.drop(*names), g, l.crs)


def buffer(l: Layer, distance: float = 1000, crs: str = "azimuthal_equidistant") -> Layer:
    """All within a distance: in metres about each feature's centroid or in its UTM zone, or in the layer's own units."""
    try:
        distance = float(distance)
    except (TypeError, ValueError):
        raise ValueError("the distance must be a number") from None
    if crs not in BUFFERS:
        raise ValueError(f"unknown buffer projection: {crs}")
    g = col(need_geometry(l))
    if crs == "same_as_feature":
        return _replaced(l, geo.st_shape("buffer", g, distance))
    out = geo.st_buffer_metric(geo.st_transform(g, l.crs, "EPSG:4326"), distance, crs)
    return _replaced(l, geo.st_transform(out, "EPSG:4326", l.crs))


def reproject(l: Layer, to: str) -> Layer:
    """Coordinates in another reference system, x before y; the same one changes nothing."""
    g, to = need_geometry(l), known_crs(to)
    return l if to == l.crs else replace(_replaced(l, geo.st_transform(col(g), l.crs, to)), crs=to)


def geometry_attributes(l: Layer, measures: Sequence[str] = ("Area (ha)", "Perimeter (km)", "Geometry type")) -> Layer:
    """Append measures: area_ha and perimeter_km in an equal-area projection, vertices, geometry_type, parts, centroid."""
    g = col(need_geometry(l))
    flat, center = geo.st_transform(g, l.crs, EQUAL_AREA), geo.st_centroid(geo.st_transform(g, l.crs, "EPSG:4326"))
    known = {
        "Area (ha)": (geo.st_area(flat) / 10_000).alias("area_ha"),
        "Perimeter (km)": ((geo.st_measure("perimeter", flat) + geo.st_measure("length", flat)) / 1000).alias("perimeter_km"),
        "Vertices": geo.st_measure("npoints", g).cast("int").alias("vertices"),
        "Geometry type": geo.st_geometrytype(g).alias("geometry_type"),
        "Parts": geo.st_measure("parts", g).cast("int").alias("parts"),
        "Centroid longitude": geo.st_x(center).alias("centroid_lon"),
        "Centroid latitude": geo.st_y(center).alias("centroid_lat"),
    }
    return l.with_df(l.df.select("*", *[known[m] for m in measures if m in known]))


def inspect_geometry(l: Layer) -> Layer:
    """Append a struct ``inspection``: type, dimension, vertices, parts, holes, validity, bounds, metric sizes and WKT.

    Of a polygon also whether its outer ring is closed and a ring, whether it is convex, and which way the ring winds;
    these are null for other types.
    """
    g = col(need_geometry(l))
    flat = geo.st_transform(g, l.crs, EQUAL_AREA)
    whole = [geo.st_measure(m, g).cast("int").alias(m) for m in ("dimension", "npoints", "parts", "holes")]
    yes = [(geo.st_measure(m, g) == 1).alias(m) for m in ("is_empty", "is_valid", "is_simple", "is_closed", "has_z", "has_m")]
    ring, winding = geo.st_shape("exterior_ring", g), geo.st_measure("winding", g)
    rings = [(geo.st_measure(m, ring) == 1).alias(n) for m, n in (("is_closed", "ring_closed"), ("is_ring", "is_ring"))]
    turns = F.when(winding == 1, "counter-clockwise").when(winding == -1, "clockwise").alias("winding")
    sizes = [geo.st_measure(m, flat).alias(f"{m}_m") for m in ("area", "length", "perimeter")]
    found = [geo.st_geometrytype(g).alias("type"), *whole, *yes, *rings, (geo.st_measure("is_convex", g) == 1).alias("is_convex"), turns, geo.st_bounds(g).alias("bounds"), *sizes, geo.st_astext(g).alias("wkt")]
    return l.with_df(l.df.select("*", F.struct(*found).alias("inspection")))


def quality_report(l: Layer) -> DataFrame:
    """``type, n, invalid, empty``: geometries by type, those without one last."""
    i = inspect_geometry(l).df.select("inspection.*")
    return i.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.col("is_empty")).alias("empty")).orderBy(F.col("type").asc_nulls_last())


def check_lonlat(l: Layer) -> DataFrame:
    """One row: the extent of a layer that says it is lon/lat, and whether it is within the globe."""
    b = bounding_box(l, "One box").df
    inside = (F.col("minx") >= -180) & (F.col("maxx") <= 180) & (F.col("miny") >= -90) & (F.col("maxy") <= 90)
    return b.select("minx", "miny", "maxx", "maxy", (F.lit(not is_lon_lat(l.crs)) | inside).alias("ok"))


def points(l: Layer, x: str, y: str, z: str | None = None, geometry: str = "geometry", crs: str | None = None) -> Layer:
    """A table's rows as points of two or three columns, which may be text; a row without x or y has no point."""
    need_columns(l.df, [x, y, *([z] if z else [])])
    xy = [col(c).try_cast("double") for c in (x, y)]
    df = l.df.select(*[col(c) for c in l.columns if c != geometry], geo.st_point(*xy, col(z).try_cast("double") if z else None).alias(geometry))
    return layer(df, geometry, crs or l.crs)
