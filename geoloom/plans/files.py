"""Queries that go through files, saved flows, SQL aggregates and rejections, over all rows of the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import fresh_path, put_bytes
from geoloom.functions import geo
from geoloom.functions.values import Condition, sql
from geoloom.layer import Layer, layer
from geoloom.operators import attributes as at
from geoloom.operators import combine, custom, geometry, order, overlay, raster, route, summarise
from geoloom.plans.relational import customers, read
from geoloom.plans.spatial import _B, _P, boxes
from geoloom.sources import rasters, readers, writers

_X, _Y = (lambda: geo.st_x(F.col("geometry"))), (lambda: geo.st_y(F.col("geometry")))


def _through(l: Layer, name: str, write: str, read_as: str) -> Layer:
    """The layer, written and read again."""
    path = fresh_path(l.df.sparkSession, name)
    writers.write(l, path, write)
    return readers.read(l.df.sparkSession, path, read_as)


def csv_files(spark, d) -> DataFrame:
    return _through(at.keep(read(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"]), "csv", "CSV", "csv").df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def geojson_files(spark, d) -> DataFrame:
    l = _through(at.keep(customers(spark, d), ["c_custkey", "c_name", "geometry"]), "geojson", "GeoJSON", "geojson")
    return l.df.select("c_custkey", "c_name", F.round(_X(), 6).alias("x"), F.round(_Y(), 6).alias("y"))


def geoparquet_files(spark, d) -> DataFrame:
    """Projected, written with its system in the footers, and moved back to lon/lat as it is read."""
    l = _through(geometry.reproject(at.keep(customers(spark, d), ["c_custkey", "geometry"]), "EPSG:3857"), "geoparquet", "GeoParquet", "parquet")
    return l.df.select("c_custkey", F.round(_X(), 6).alias("x"), F.round(_Y(), 6).alias("y"))


def _density_file(spark, d) -> rasters.Rasters:
    """A GeoTIFF of the number of customers in each square degree, made of their counts: as many as the map has squares at most."""
    import numpy as np

    counts = customers(spark, d).df.groupBy(F.floor("lon").cast("int").alias("x"), F.floor(90 - F.col("lat")).cast("int").alias("y")).agg(F.count("*").alias("n"))
    grid = np.zeros((180, 360))
    for r in counts.where("x BETWEEN -180 AND 179 AND y BETWEEN 0 AND 179").collect():
        grid[r["y"], r["x"] + 180] = r["n"]
    path = f"{fresh_path(spark, 'density')}/density.tif"
    put_bytes(spark, path, rasters.geotiff(grid, (1.0, 0.0, -180.0, 0.0, -1.0, 90.0), nodata=0, side=32))
    return rasters.open_rasters(spark, path)


def raster_file_sample(spark, d) -> DataFrame:
    """Each customer's square degree, looked up in a file's blocks."""
    return raster.sample_raster(customers(spark, d), _density_file(spark, d)).df.select("c_custkey", F.col("raster_value").alias("n"))


def raster_file_blocks(spark, d) -> DataFrame:
    """The blocks of that file: their places, and the customers counted in each."""
    t = _density_file(spark, d).tiles
    return t.select("bx", "by", "x0", "y0", "w", "h", F.aggregate("pixels", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))).alias("n"))


def relabelled(spark, d) -> DataFrame:
    """Numbers that are taken for metres, and moved to lon/lat as such."""
    l = geometry.reproject(at.set_crs(customers(spark, d), "EPSG:3857"), "EPSG:4326")
    return l.df.select("c_custkey", F.round(_X(), 9).alias("x"), F.round(_Y(), 9).alias("y"))


def texts_tested(spark, d) -> DataFrame:
    l = at.create(read(spark, d, "part"), [("note", sql("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END"))])
    ports = route.tester(l, [Condition("note", "contains", "e"), Condition("note", "is null", None, join="OR")])
    return ports["passed"].df.select(F.lit("passed").alias("port"), "p_partkey").unionByName(ports["failed"].df.select(F.lit("failed").alias("port"), "p_partkey"))


def sql_set_operators(spark, d) -> DataFrame:
    return at.transform_sql(read(spark, d, "orders"), "SELECT o_custkey FROM input WHERE o_totalprice > 100000 INTERSECT SELECT o_custkey FROM input WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM input WHERE o_orderstatus = 'P'").df


def sql_rollup(spark, d) -> DataFrame:
    return at.transform_sql(read(spark, d, "orders"), "SELECT o_orderstatus, year(o_orderdate) AS y, grouping_id() AS g, count(*) AS n FROM input GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))").df.select("o_orderstatus", F.col("y").cast("long").alias("y"), F.col("g").cast("long").alias("g"), "n")


def sql_text_functions(spark, d) -> DataFrame:
    return at.transform_sql(read(spark, d, "nation"), "SELECT n_nationkey, lpad(lower(trim(n_name)), 12, '.') AS a, replace(n_name, 'A', '*') AS b, array_join(transform(split(n_name, ' '), w -> lower(w)), '-') AS c, nullif(n_regionkey, 1) AS d FROM input").df


def sql_unions_of_shapes(spark, d) -> DataFrame:
    """Unit squares united by SQL: the area is the number of different squares, the extent that of the corners."""
    # A nation's squares come by belts of ten degrees to many tasks, so that what is first united lies together.
    p = customers(spark, d).df.repartition("c_nationkey", F.floor(F.col("lon") / 10))
    l = layer(p.select("c_nationkey", geo.st_box(F.floor("lon"), F.floor("lat"), F.floor("lon") + 1, F.floor("lat") + 1).alias("geometry")), "geometry")
    out = at.transform_sql(l, "SELECT c_nationkey, st_area(st_union_agg(geometry)) AS area, st_extent_agg(geometry) AS e FROM input GROUP BY c_nationkey").df
    b = geo.st_bounds(F.col("e"))
    return out.select("c_nationkey", F.round("area", 6).alias("area"), b["minx"].alias("minx"), b["maxy"].alias("maxy"))


def ring_inspection(spark, d) -> DataFrame:
    i = geometry.inspect_geometry(boxes(spark, d)).df
    return i.select("s_suppkey", "inspection.type", "inspection.npoints", "inspection.holes", "inspection.is_valid", "inspection.has_z", "inspection.is_ring", "inspection.is_convex", F.col("inspection.bounds.maxx").alias("maxx"))


def lonlat_check(spark, d) -> DataFrame:
    return geometry.check_lonlat(boxes(spark, d))


def overlay_rejections(spark, d) -> DataFrame:
    """Rows that can't be overlaid, each with the first reason that holds."""
    k, b = F.col("s_suppkey"), boxes(spark, d)
    shape = F.when(k % 6 == 0, F.lit(None).cast("binary")).when(k % 6 == 1, geo.st_point(F.col("x"), F.col("y"))).otherwise(F.col("geometry"))
    name = F.when(k % 6 == 2, " ").when(k % 6 == 3, "same").otherwise(k.cast("string"))
    l = layer(b.df.select("s_suppkey", name.alias("name"), shape.alias("geometry")), "geometry")
    return overlay.overlay(l, id_attribute="name")["rejected"].df.select("s_suppkey", "rejection_code")


def accumulated_names(spark, d) -> DataFrame:
    """Boxes on one spot, one above the other: a face for each spot, with the distinct names that lie there."""
    k = F.col("s_suppkey")
    df = read(spark, d, "supplier").df.withColumn("x", (k % 50 * 3).cast("double"))
    l = layer(df.select("s_suppkey", (k % 7).cast("string").alias("kind"), "x", geo.st_box(F.col("x"), F.lit(0), F.col("x") + 1, F.lit(1)).alias("geometry")), "geometry")
    out = overlay.overlay(l, accumulate=["kind"], separator="|")["output"].df
    return out.select(geo.st_bounds(F.col("geometry"))["minx"].alias("x"), F.col("_overlaps").alias("n"), "kind")


def shared_areas(spark, d) -> DataFrame:
    """The area that boxes of twenty degrees share, for every two that meet."""
    a = boxes(spark, d)
    a = a.with_df(a.df.withColumn("geometry", geo.st_box(F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + 20)))
    left = layer(a.df.select("s_suppkey", "geometry"), "geometry")
    right = layer(a.df.select(F.col("s_suppkey").alias("other"), F.col("geometry").alias("shape")), "shape")
    area = lambda one, two: F.round(geo.st_area(geo.st_intersection(one, two)), 6)
    return combine.spatial_join(left, right, measures={"area": area}).df.where("s_suppkey < other").select("s_suppkey", "other", "area")


def capped_count(spark, d) -> DataFrame:
    n = order.preview_count(read(spark, d, "lineitem"), cap=5000)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


def sampler_passes_all(spark, d) -> DataFrame:
    """An amount that is no number, or not above zero, keeps every row."""
    l = at.keep(read(spark, d, "part"), ["p_partkey"])
    return order.sample(order.sample(l, "First N", "many"), "Every Nth", -1).df


def user_operator(spark, d) -> DataFrame:
    top = custom.define_operator("top", [custom.Param("by", "column"), custom.Param("least", "number", 0), custom.Param("tag", "text", "")], [("kept", "SELECT * FROM {{inputs.input}} WHERE {{params.by}} >= {{params.least}}"), ("out", "SELECT o_custkey, count(*) AS n, {{params.tag}} AS tag FROM {{steps.kept}} GROUP BY o_custkey")])
    return top(read(spark, d, "orders"), by="o_totalprice", least=150000, tag="it's").df


def saved_flow(spark, d) -> DataFrame:
    """Read, test, aggregate: the flow is text, its ports are layers."""
    graph = {
        "nodes": [{"id": "r", "operator": "read"}, {"id": "t", "operator": "test", "params": {"column": "o_orderstatus", "value": "F"}}, {"id": "a", "operator": "count"}, {"id": "b", "operator": "count"}],
        "edges": [{"from": "r", "to": "t"}, {"from": "t", "fromPort": "passed", "to": "a"}, {"from": "t", "fromPort": "failed", "to": "b"}],
    }
    known = {
        "read": lambda i, p: read(spark, d, "orders"), "test": lambda i, p: route.tester(i["input"], [Condition(p["column"], "=", p["value"])]),
        "count": lambda i, p: summarise.aggregate(i["input"], ["o_orderstatus"], [("count", None, "n")]),
    }
    ports = custom.Flow.from_json(json.dumps(graph), known).build()
    return combine.union_by_name(ports["a", "output"], ports["b", "output"]).df


QUERIES = {
    f.__name__: f
    for f in (
        csv_files, geojson_files, geoparquet_files, raster_file_sample, raster_file_blocks, relabelled, texts_tested, sql_set_operators, sql_rollup, sql_text_functions, sql_unions_of_shapes, ring_inspection, lonlat_check, overlay_rejections,
        accumulated_names, shared_areas, capped_count, sampler_passes_all, user_operator, saved_flow,
    )
}

_OVER = "(20 - abs(a.x - b.x)) * (20 - abs(a.y - b.y))"

ORACLES = {
    "csv_files": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders",
    "geojson_files": f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, round(lon, 6) AS x, round(lat, 6) AS y FROM {_P}",
    "geoparquet_files": f"SELECT c_custkey, round(lon, 6) AS x, round(lat, 6) AS y FROM {_P}",
    "raster_file_sample": f"SELECT c_custkey, CAST(count(*) OVER (PARTITION BY floor(lon), floor(90 - lat)) AS DOUBLE) AS n FROM {_P}",
    "raster_file_blocks": f"SELECT CAST(bx AS INTEGER) AS bx, CAST(\"by\" AS INTEGER) AS \"by\", CAST(bx * 32 AS INTEGER) AS x0, CAST(\"by\" * 32 AS INTEGER) AS y0, CAST(least(32, 360 - bx * 32) AS INTEGER) AS w, CAST(least(32, 180 - \"by\" * 32) AS INTEGER) AS h, CAST(count(lon) AS DOUBLE) AS n FROM (SELECT x.x AS bx, y.y AS \"by\" FROM range(0, 12) x(x), range(0, 6) y(y)) g LEFT JOIN {_P} p ON floor((floor(lon) + 180) / 32) = bx AND floor(floor(90 - lat) / 32) = \"by\" GROUP BY bx, \"by\"",
    "relabelled": f"SELECT c_custkey, round(degrees(lon / 6378137.0), 9) AS x, round(degrees(2 * atan(exp(lat / 6378137.0)) - pi() / 2), 9) AS y FROM {_P}",
    "texts_tested": "SELECT CASE WHEN p_partkey % 3 = 0 OR contains(p_name, 'e') THEN 'passed' ELSE 'failed' END AS port, p_partkey FROM part",
    "sql_set_operators": "(SELECT o_custkey FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "sql_rollup": "SELECT o_orderstatus, year(CAST(o_orderdate AS DATE)) AS y, grouping(o_orderstatus, year(CAST(o_orderdate AS DATE))) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, year(CAST(o_orderdate AS DATE)))",
    "sql_text_functions": "SELECT n_nationkey, lpad(lower(trim(n_name)), 12, '.') AS a, replace(n_name, 'A', '*') AS b, array_to_string(list_transform(string_split(n_name, ' '), lambda w: lower(w)), '-') AS c, nullif(n_regionkey, 1) AS d FROM nation",
    "sql_unions_of_shapes": f"SELECT c_nationkey, CAST(count(DISTINCT (floor(lon), floor(lat))) AS DOUBLE) AS area, min(floor(lon)) AS minx, max(floor(lat)) + 1 AS maxy FROM {_P} GROUP BY c_nationkey",
    "ring_inspection": f"SELECT s_suppkey, 'POLYGON' AS type, CAST(5 AS INTEGER) AS npoints, CAST(0 AS INTEGER) AS holes, true AS is_valid, false AS has_z, true AS is_ring, true AS is_convex, x + w AS maxx FROM {_B}",
    "lonlat_check": f"SELECT min(x) AS minx, min(y) AS miny, max(x + w) AS maxx, max(y + h) AS maxy, true AS ok FROM {_B}",
    "overlay_rejections": "SELECT s_suppkey, ['no_geometry', 'no_polygon', 'missing_id', 'duplicate_id'][CAST(s_suppkey % 6 AS INTEGER) + 1] AS rejection_code FROM supplier WHERE s_suppkey % 6 < 3 OR (s_suppkey % 6 = 3 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 6 = 3) > 1)",
    "accumulated_names": "SELECT CAST(s_suppkey % 50 * 3 AS DOUBLE) AS x, count(*) AS n, string_agg(DISTINCT CAST(s_suppkey % 7 AS VARCHAR), '|' ORDER BY CAST(s_suppkey % 7 AS VARCHAR)) AS kind FROM supplier GROUP BY 1",
    "shared_areas": f"SELECT a.s_suppkey, b.s_suppkey AS other, round({_OVER}, 6) AS area FROM {_B} a JOIN {_B} b ON a.s_suppkey < b.s_suppkey AND abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20",
    "capped_count": "SELECT least(count(*), 5001) AS n FROM lineitem",
    "sampler_passes_all": "SELECT p_partkey FROM part",
    "user_operator": "SELECT o_custkey, count(*) AS n, 'it''s' AS tag FROM orders WHERE o_totalprice >= 150000 GROUP BY o_custkey",
    "saved_flow": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
}
