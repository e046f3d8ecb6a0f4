"""Queries over the driver's tables that use geometry operators; the tables' keys give points and boxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import attr
from geoloom.layer import Layer, layer
from geoloom.operators import attributes as at
from geoloom.operators import combine, geometry, h3, overlay, raster, route, summarise, vertex
from geoloom.plans.relational import _CELL, PARENT, customers, read
from geoloom.sources import writers


def boxes(spark: SparkSession, d: str, name: str = "supplier", key: str = "s_suppkey") -> Layer:
    """A box for each row: its corner on a grid of whole degrees, one to four degrees wide and high."""
    k = F.col(key)
    df = read(spark, d, name).df.withColumn("x", (k * 37 % 300 - 150).cast("double")).withColumn("y", (k * 53 % 120 - 60).cast("double"))
    df = df.withColumn("w", (k % 4 + 1).cast("double")).withColumn("h", (k % 3 + 1).cast("double"))
    return layer(df.withColumn("geometry", geo.st_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))), "geometry")


def measures_box(spark, d) -> DataFrame:
    out = geometry.geometry_attributes(boxes(spark, d), geometry.MEASURES).df
    return out.select("s_suppkey", F.round("area_ha", 2).alias("area_ha"), "vertices", "geometry_type", "parts", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


def area_filter(spark, d) -> DataFrame:
    ports = route.filter_by_area(boxes(spark, d), 2_000_000, 9_000_000)
    return ports["kept"].df.select(F.lit("kept").alias("port"), "s_suppkey").unionByName(ports["removed"].df.select(F.lit("removed").alias("port"), "s_suppkey"))


def bbox_features(spark, d) -> DataFrame:
    return geometry.bounding_box(boxes(spark, d)).df.select("s_suppkey", "minx", "miny", "maxx", "maxy")


def bbox_all(spark, d) -> DataFrame:
    return geometry.bounding_box(boxes(spark, d), "One box").df.select("minx", "miny", "maxx", "maxy")


def hull_each(spark, d) -> DataFrame:
    out = geometry.convex_hull(boxes(spark, d)).df
    return out.select("s_suppkey", F.round(geo.st_area(F.col("geometry")), 6).alias("area"))


def hull_all(spark, d) -> DataFrame:
    """The hull of all customers: its bounds, that it is convex, and that nobody is outside."""
    c = customers(spark, d)
    hull = geometry.convex_hull(c, "Whole layer").df.select(F.col("geometry").alias("hull"))
    b = geo.st_bounds(F.col("hull"))
    outside = c.df.crossJoin(F.broadcast(hull)).where(geo.st_distance(F.col("geometry"), F.col("hull")) > 1e-9)  # one row for all
    measured = hull.select(b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"), (F.abs(geo.st_area(geo.st_shape("convex_hull", F.col("hull"))) - geo.st_area(F.col("hull"))) < 1e-6).alias("convex"))
    return measured.crossJoin(F.broadcast(outside.agg(F.count("*").alias("outside"))))


def simplify_densify(spark, d) -> DataFrame:
    l = geometry.densify(boxes(spark, d), 0.75)
    slim = geometry.simplify(l, 0.01)
    return l.df.select("s_suppkey", geo.st_measure("npoints", F.col("geometry")).cast("int").alias("dense"), F.round(geo.st_area(F.col("geometry")), 6).alias("area")).join(slim.df.select("s_suppkey", geo.st_measure("npoints", F.col("geometry")).cast("int").alias("slim")), "s_suppkey")


def buffer_points(spark, d) -> DataFrame:
    out = geometry.buffer(customers(spark, d), 0.5, "same_as_feature").df
    return out.select("c_custkey", F.round(geo.st_area(F.col("geometry")), 6).alias("area"))


def reproject_mercator(spark, d) -> DataFrame:
    out = geometry.reproject(customers(spark, d), "EPSG:3857").df
    return out.select("c_custkey", F.round(geo.st_x(F.col("geometry")), 3).alias("x"), F.round(geo.st_y(F.col("geometry")), 3).alias("y"))


def dissolve_grid(spark, d) -> DataFrame:
    """Unit squares at the customers' whole degrees, dissolved by nation: the area is the number of different squares."""
    df = customers(spark, d).df.select("c_nationkey", F.floor("lon").cast("double").alias("x"), F.floor("lat").cast("double").alias("y"))
    l = layer(df.withColumn("geometry", geo.st_box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)), "geometry")
    out = summarise.dissolve(l, ["c_nationkey"]).df
    return out.select("c_nationkey", "parts", F.round(geo.st_area(F.col("geometry")), 6).alias("area"))


def spatial_join_points_boxes(spark, d) -> DataFrame:
    return combine.spatial_join(customers(spark, d), boxes(spark, d)).df.select("c_custkey", "s_suppkey")


def overlay_grid(spark, d) -> DataFrame:
    """Boxes on whole degrees: the faces of each depth add up to as many unit squares as that many boxes cover."""
    out = overlay.overlay(boxes(spark, d))["output"].df
    return out.groupBy("_overlaps").agg(F.round(F.sum(geo.st_area(F.col("geometry"))), 6).alias("area"))


def overlay_memberships(spark, d) -> DataFrame:
    """The area of each box is that of the faces it covers."""
    ports = overlay.overlay(boxes(spark, d), id_attribute="s_suppkey")
    faces = ports["output"].df.select("face_id", geo.st_area(F.col("geometry")).alias("area"))
    return ports["memberships"].df.join(faces, "face_id").groupBy("feature_id").agg(F.round(F.sum("area"), 6).alias("area"))


def vertex_points(spark, d) -> DataFrame:
    l = customers(spark, d)
    out = vertex.vertex(l, "Add Point", attr("c_nationkey"), attr("c_acctbal"))["output"].df
    g = F.col("geometry")
    return out.select("c_custkey", geo.st_geometrytype(g).alias("kind"), geo.st_measure("npoints", g).cast("int").alias("n"), F.round(geo.st_bounds(g)["maxy"], 6).alias("maxy"))


def density_tiles(spark, d) -> DataFrame:
    """A raster in tiles of 10 by 10 degrees: the number of customers in each square degree, nodata where there is none."""
    cells = customers(spark, d).df.groupBy(F.floor("lon").cast("int").alias("lon"), F.floor(90 - F.col("lat")).cast("int").alias("r")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("c", F.col("lon") + 180)
    tile = cells.groupBy(F.floor(F.col("c") / 10).cast("int").alias("bx"), F.floor(F.col("r") / 10).cast("int").alias("by"))
    tile = tile.agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") % 10 * 10 + F.col("c") % 10).cast("int").alias("k"), F.col("n").cast("double").alias("v")))).alias("m"))
    ten = F.lit(10)
    return tile.select(
        F.lit("density").alias("raster"), F.lit(1).alias("band"), "bx", "by", (F.col("bx") * 10).alias("x0"), (F.col("by") * 10).alias("y0"), ten.alias("w"), ten.alias("h"), ten.alias("bw"), ten.alias("bh"),
        F.array(*[F.lit(float(v)) for v in (1, 0, -180, 0, -1, 90)]).alias("transform"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.col("m")[k]).alias("pixels"),
    )


def raster_sample(spark, d) -> DataFrame:
    """Each customer's square degree, looked up in the tiles made of all customers."""
    return raster.sample_raster(customers(spark, d), density_tiles(spark, d)).df.select("c_custkey", F.col("raster_value").alias("n"))


def raster_areas(spark, d) -> DataFrame:
    """The areas of equal density: a square degree each cell."""
    out = raster.raster_to_polygons(density_tiles(spark, d)).df
    return out.groupBy("value").agg(F.round(F.sum(geo.st_area(F.col("geometry"))), 6).alias("area"))


def geojson_text(spark, d) -> DataFrame:
    """Customers' nations as features' properties: how many features each has in the text that would be written."""
    lines = writers.geojson_features(at.keep(customers(spark, d), ["c_nationkey", "geometry"]))
    return lines.groupBy(F.get_json_object("value", "$.properties.c_nationkey").cast("int").alias("c_nationkey")).agg(F.count("*").alias("n"), F.round(F.avg(F.get_json_object("value", "$.geometry.coordinates[0]").cast("double")), 6).alias("lon"))


def geometry_report(spark, d) -> DataFrame:
    return geometry.quality_report(boxes(spark, d))


def point_duplicates(spark, d) -> DataFrame:
    """Geometry as the key of the duplicate filter."""
    df = customers(spark, d).df.withColumn("geometry", geo.st_point(F.floor("lon"), F.floor("lat")))
    ports = route.duplicate_filter(layer(df, "geometry"), ["geometry"], ["c_custkey"])
    return ports["unique"].df.select("c_custkey")


def h3_cell_shapes(spark, d) -> DataFrame:
    """All orders as cells below a parent, by their place: each cell's hexagon, its corners and its centre."""
    o = read(spark, d, "orders").df.select("o_orderkey", (F.col("o_orderkey") % 343).cast("long").alias("file_row_number"))
    out = h3.position_shapes(layer(o), PARENT, rows=343).df
    centre = geo.cell_centre(h3.cell_number(F.col("h3_index")))
    ring = geo.st_vertices(F.col("geometry"))
    middle = lambda f: F.aggregate(F.slice(ring, 1, 6), F.lit(0.0), lambda s, v: s + v[f]) / 6
    near = (F.abs(middle("x") - geo.st_x(centre)) < 1e-5) & (F.abs(middle("y") - geo.st_y(centre)) < 1e-5)
    return out.select("o_orderkey", "h3_index", F.round(geo.st_x(centre), 7).alias("lon"), F.round(geo.st_y(centre), 7).alias("lat"), geo.st_measure("npoints", F.col("geometry")).cast("int").alias("points"), near.alias("centred"))


def customer_boxes(spark, d) -> Layer:
    """A box of a tenth to four tenths of a degree at each customer's place, kept off the poles and the antimeridian."""
    c, side = customers(spark, d).df, lambda k, m: (F.col("c_custkey") % m + 1) / 10
    lon, lat = F.least(F.col("lon"), F.lit(179.0)), F.col("lat") * 0.8
    return layer(c.withColumn("geometry", geo.st_box(lon, lat, lon + side("c_custkey", 4), lat + side("c_custkey", 3))), "geometry")


def h3_polygon_cells(spark, d) -> DataFrame:
    """Every customer's box filled with cells: none twice, none with its centre outside, and together of the box's area to within its outline."""
    l = customer_boxes(spark, d)
    l = layer(l.df.select("c_custkey", "geometry", geo.st_bounds(F.col("geometry")).alias("box")), "geometry")
    cells = h3.polygon_cells(l, 5).df.withColumn("centre", geo.cell_centre(h3.cell_number(F.col("h3_index"))))
    x, y = geo.st_x(F.col("centre")), geo.st_y(F.col("centre"))
    outside = ~(x.between(F.col("box.minx"), F.col("box.maxx")) & y.between(F.col("box.miny"), F.col("box.maxy")))
    wide = geo.st_bounds(F.col("geometry"))
    by = cells.groupBy("c_custkey", "box").agg(
        F.count("*").alias("n"), F.count_distinct("h3_index").alias("different"), F.count_if(outside).alias("outside"), F.sum(geo.st_area(F.col("geometry"))).alias("area"), F.max(F.greatest(wide["maxx"] - wide["minx"], wide["maxy"] - wide["miny"])).alias("size")
    )
    w, h = F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny")
    fits = F.abs(F.col("area") - w * h) <= 2 * (w + h) * F.col("size") + 4 * F.col("size") * F.col("size")
    found = by.select(F.col("c_custkey").alias("key"), (F.col("n") - F.col("different")).alias("twice"), "outside", fits.alias("fits"))
    # A box may be so small that no centre is inside.
    return l.df.select("c_custkey").join(found, F.col("c_custkey") == F.col("key"), "left").select("c_custkey", F.coalesce("twice", F.lit(0)).alias("twice"), F.coalesce("outside", F.lit(0)).alias("outside"), F.coalesce("fits", F.lit(True)).alias("fits"))


QUERIES = {
    f.__name__: f
    for f in (h3_cell_shapes, h3_polygon_cells, measures_box, area_filter, bbox_features, bbox_all, hull_all, hull_each, simplify_densify, buffer_points, reproject_mercator, dissolve_grid, spatial_join_points_boxes, overlay_grid, overlay_memberships, vertex_points, raster_sample, raster_areas, geojson_text, geometry_report, point_duplicates)
}

_P = "(SELECT *, CAST(((c_custkey * 7919) % 36000) / 100.0 - 180 AS DOUBLE) AS lon, CAST(((c_custkey * 104729) % 17000) / 100.0 - 85 AS DOUBLE) AS lat FROM customer)"
_B = "(SELECT *, CAST(s_suppkey * 37 % 300 - 150 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 120 - 60 AS DOUBLE) AS y, CAST(s_suppkey % 4 + 1 AS DOUBLE) AS w, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS h FROM supplier)"
_E = 0.08181919084262149
_Q = lambda v: f"((1 - {_E}*{_E}) * (sin(radians({v})) / (1 - {_E}*{_E}*sin(radians({v}))*sin(radians({v}))) - ln((1 - {_E}*sin(radians({v}))) / (1 + {_E}*sin(radians({v})))) / (2*{_E})))"
_AREA = f"(6378137.0 * 6378137.0 * radians(w) * ({_Q('y + h')} - {_Q('y')}) / 2 / 10000)"
_SQUARES = f"(SELECT s_suppkey, x + i.i AS sx, y + j.j AS sy FROM {_B}, range(0, 4) i(i), range(0, 3) j(j) WHERE i.i < w AND j.j < h)"



def _cells_sql() -> str:
    """The centres by complex numbers on the parent's face: digits in turn over 3+ww and 3+w, w the third root of one."""
    w, parent = complex(-0.5, math.sqrt(3) / 2), int(PARENT, 16)
    steps = [0, w**2, w, w + w**2, 1, 1 + w**2, 1 + w]
    # The parent's base cell lies at ww on its face: centre, and azimuth of its first corner.
    lat, lng, az = 0.427370518328979641, -1.888876200336285401, 3.532912002790141181
    z, unit, finer = w**2, 1, []
    for r in range(1, 9):
        unit /= 3 + (w**2 if r % 2 else w)
        if r <= 5:
            z += unit * steps[parent >> 3 * (15 - r) & 7]
        else:
            finer.append([unit * s for s in steps])
    north, east = (-math.sin(lat) * math.cos(lng), -math.sin(lat) * math.sin(lng), math.cos(lat)), (-math.sin(lng), math.cos(lng), 0.0)
    up = (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat))
    to = [(math.cos(az) * n + math.sin(az) * e, math.sin(az) * n - math.cos(az) * e) for n, e in zip(north, east, strict=True)]
    k = "(o_orderkey % 343)"
    digits = (f"{k} // 49", f"{k} // 7 % 7", f"{k} % 7")
    place = lambda part: " + ".join([repr(part(z)), *[f"[{', '.join(repr(part(s)) for s in own)}][CAST({d} AS INTEGER) + 1]" for own, d in zip(finer, digits, strict=True)]])
    axes = ", ".join(f"{u!r} + 0.381966011250105 * (x * {a!r} + y * {b!r}) AS {c}" for c, u, (a, b) in zip("pqr", up, to, strict=True))
    return f"SELECT o_orderkey, h3_index, round(degrees(atan2(q, p)), 7) AS lon, round(degrees(atan2(r, sqrt(p * p + q * q))), 7) AS lat, CAST(7 AS INTEGER) AS points, true AS centred FROM (SELECT o_orderkey, h3_index, {axes} FROM (SELECT o_orderkey, lower(lpad(printf('%x', {_CELL}), 15, '0')) AS h3_index, {place(lambda c: complex(c).real)} AS x, {place(lambda c: complex(c).imag)} AS y FROM orders))"


ORACLES = {
    "h3_cell_shapes": _cells_sql(),
    "h3_polygon_cells": "SELECT c_custkey, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS outside, true AS fits FROM customer",
    "measures_box": f"SELECT s_suppkey, round({_AREA}, 2) AS area_ha, CAST(5 AS INTEGER) AS vertices, 'POLYGON' AS geometry_type, CAST(1 AS INTEGER) AS parts, round(x + w / 2, 6) AS centroid_lon, round(y + h / 2, 6) AS centroid_lat FROM {_B}",
    "area_filter": f"SELECT CASE WHEN {_AREA} BETWEEN 2000000 AND 9000000 THEN 'kept' ELSE 'removed' END AS port, s_suppkey FROM {_B}",
    "bbox_features": f"SELECT s_suppkey, x AS minx, y AS miny, x + w AS maxx, y + h AS maxy FROM {_B}",
    "bbox_all": f"SELECT min(x) AS minx, min(y) AS miny, max(x + w) AS maxx, max(y + h) AS maxy FROM {_B}",
    "hull_all": f"SELECT min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy, true AS convex, CAST(0 AS BIGINT) AS outside FROM {_P}",
    "hull_each": f"SELECT s_suppkey, round(w * h, 6) AS area FROM {_B}",
    "simplify_densify": f"SELECT s_suppkey, CAST(2 * (floor(w / 0.75) + 1) + 2 * (floor(h / 0.75) + 1) + 1 AS INTEGER) AS dense, round(w * h, 6) AS area, CAST(5 AS INTEGER) AS slim FROM {_B}",
    "buffer_points": "SELECT c_custkey, round(16 * 0.25 * sin(2 * pi() / 32), 6) AS area FROM customer",
    "reproject_mercator": f"SELECT c_custkey, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM {_P}",
    "dissolve_grid": f"SELECT c_nationkey, count(*) AS parts, CAST(count(DISTINCT (floor(lon), floor(lat))) AS DOUBLE) AS area FROM {_P} GROUP BY c_nationkey",
    "spatial_join_points_boxes": f"SELECT c_custkey, s_suppkey FROM {_P} JOIN {_B} ON lon BETWEEN x AND x + w AND lat BETWEEN y AND y + h",
    "overlay_grid": f"SELECT n AS _overlaps, CAST(count(*) AS DOUBLE) AS area FROM (SELECT sx, sy, count(*) AS n FROM {_SQUARES} GROUP BY sx, sy) GROUP BY n",
    "overlay_memberships": f"SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, round(w * h, 6) AS area FROM {_B}",
    "raster_sample": f"SELECT c_custkey, CAST(count(*) OVER (PARTITION BY floor(lon), floor(90 - lat)) AS DOUBLE) AS n FROM {_P}",
    "raster_areas": f"SELECT CAST(n AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS area FROM (SELECT count(*) AS n FROM {_P} GROUP BY floor(lon), floor(90 - lat)) GROUP BY n",
    "geojson_text": f"SELECT c_nationkey, count(*) AS n, round(avg(lon), 6) AS lon FROM {_P} GROUP BY c_nationkey",
    "geometry_report": "SELECT 'POLYGON' AS type, count(*) AS n, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS empty FROM supplier",
    "point_duplicates": f"SELECT min(c_custkey) AS c_custkey FROM {_P} GROUP BY floor(lon), floor(lat)",
    "vertex_points": f"SELECT c_custkey, 'LINESTRING' AS kind, CAST(2 AS INTEGER) AS n, round(greatest(lat, c_acctbal), 6) AS maxy FROM {_P}",
}
