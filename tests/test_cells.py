import math
import re
import time

import pytest
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.layer import layer
from geoloom.operators import h3
from geoloom.sources import readers, writers


def points(wkt):
    return [tuple(map(float, p.split())) for p in re.findall(r"-?[\d.eE-]+ -?[\d.eE-]+", wkt)]


def same_ring(a, b):
    """Whether two rings have the same corners in the same order, wherever they begin."""
    a, b = points(a)[:-1], points(b)[:-1]
    return len(a) == len(b) and any(all(abs(x - u) + abs(y - v) < 1e-11 for (x, y), (u, v) in zip(a, b[k:] + b[:k], strict=True)) for k in range(len(a)))


#: Cells and their hexagons, as they must come out.
HEXAGONS = {
    "8a1f8d7a49a7fff": "POLYGON ((11.572820115676455 48.1388658441053, 11.57254030293573 48.13822169316727, 11.573258384194206 48.137778736480215, 11.574256282772167 48.13797992748678, 11.574536111428637 48.13862407846324, 11.573818025591516 48.13906703839477, 11.572820115676455 48.1388658441053))",
    "8a1f8d7a49b7fff": "POLYGON ((11.571542413267826 48.138020488136306, 11.571262616194767 48.137376329701496, 11.571980692873828 48.1369333762588, 11.572978571205478 48.137134578006616, 11.573258384194206 48.137778736480215, 11.57254030293573 48.13822169316727, 11.571542413267826 48.138020488136306))",
    "871f8ed86ffffff": "POLYGON ((8.542371170089814 47.402872231686366, 8.543932277340094 47.390770269994896, 8.560730302347313 47.38638290920714, 8.575972103013614 47.39409729166564, 8.574415748554546 47.4062002949539, 8.557612839688282 47.41058787457804, 8.542371170089814 47.402872231686366))",
}
BOX = "POLYGON ((8.5 47.35, 8.56 47.35, 8.56 47.4, 8.5 47.4, 8.5 47.35))"
CENTRED = ["871f8ed86ffffff", "871f8ed90ffffff", "871f8ed94ffffff", "871f8ed95ffffff", "871f8edb3ffffff"]
OVERLAPPING = ["871f8ed86ffffff", "871f8ed90ffffff", "871f8ed91ffffff", "871f8ed92ffffff", "871f8ed93ffffff", "871f8ed94ffffff", "871f8ed95ffffff", "871f8ed96ffffff", "871f8edb0ffffff", "871f8edb2ffffff", "871f8edb3ffffff"]
BOXES_OVERLAPPING = ["871f83365ffffff", "871f83ac9ffffff", "871f8ed82ffffff", "871f8ed84ffffff", *OVERLAPPING[:8], "871f8ed9effffff", "871f8edb0ffffff", "871f8edb1ffffff", "871f8edb2ffffff", "871f8edb3ffffff", "871f8edb6ffffff"]


def shapes_of(l):
    return {r.c: r.w for r in l.df.select(F.col("h3_index").alias("c"), geo.st_astext(F.col(l.geometry)).alias("w")).collect()}


def polygons(spark, *wkts):
    geo.register(spark)
    df = spark.createDataFrame([(k, w, "x") for k, w in enumerate(wkts)], "id int, wkt string, h3_index string")
    return layer(df.withColumn("geometry", geo.st_geomfromtext(F.col("wkt"))).drop("wkt"), "geometry")


def filled(l, *args, **kw):
    out = {}
    for r in h3.polygon_cells(l, *args, **kw).df.collect():
        out.setdefault(r.id, []).append(r.h3_index)
    assert all(len(set(v)) == len(v) for v in out.values())
    return {k: sorted(v) for k, v in out.items()}


def test_hexagons(spark):
    df = spark.createDataFrame([(c, 1.0) for c in HEXAGONS] + [(None, 3.0), ("8a1f8d7a49a7000", 4.0), ("nothing", 5.0), ("08A1F8D7A49A7FFF", 6.0)], "h3_index string, v double")
    out = h3.cell_shapes(layer(df))
    assert out.columns == ["h3_index", "v", "geometry"] and out.crs == "EPSG:4326"
    got = shapes_of(out)
    assert all(same_ring(got[c], w) for c, w in HEXAGONS.items()) and got["8a1f8d7a49a7000"] is None and got["nothing"] is None and None not in got
    assert same_ring(got["08A1F8D7A49A7FFF"], HEXAGONS["8a1f8d7a49a7fff"])
    numbers = df.select(h3.cell_number(F.col("h3_index")).alias("h3_index"), F.lit(b"x").alias("hex"))
    assert shapes_of(h3.cell_shapes(layer(numbers), geometry="hex"))[int("8a1f8d7a49a7fff", 16)].startswith("POLYGON")
    assert h3.cell_shapes(layer(df.limit(0))).df.count() == 0
    with pytest.raises(ValueError):
        h3.cell_shapes(layer(df), every=0)


def test_hexagons_by_place(spark):
    df = spark.range(7).selectExpr("id AS file_row_number", "(id + 1) / 10 AS value")
    out = h3.position_shapes(layer(df), "891f8d7a49bffff", rows=7)
    assert out.columns == ["value", "h3_index", "geometry"]
    got = shapes_of(out)
    assert len(got) == 7 and all(same_ring(got[c], HEXAGONS[c]) for c in ("8a1f8d7a49a7fff", "8a1f8d7a49b7fff"))
    assert h3.position_shapes(layer(df), "891f8d7a49bffff", rows=7, every=3).df.count() == 3


def test_all_cells_tile_the_sphere(spark):
    """At each resolution the corners of three cells meet, and cells at the corners of the faces have five."""
    geo.register(spark)
    pentagons = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    cells = spark.range(122).select(((F.lit(8).cast("long") * 2**56) + F.col("id") * 2**45 + (2**45 - 1)).alias("cell"))
    for resolution in range(4):
        if resolution:
            shift = 3 * (15 - resolution)
            down = F.col("cell").bitwiseAND(F.lit(~(15 << 52) & ~(7 << shift)).cast("long")).bitwiseOR(F.lit(resolution << 52).cast("long"))
            cells = cells.select(F.explode(F.array(*[down.bitwiseOR(F.lit(d << shift).cast("long")) for d in range(7)])).alias("cell"))
        shapes = cells.select("cell", geo.cell_shape(F.col("cell")).alias("g")).where("g IS NOT NULL")
        assert shapes.count() == 2 + 120 * 7**resolution
        n = {r.n: r["count"] for r in shapes.groupBy(geo.st_measure("npoints", F.col("g")).alias("n")).count().collect()}
        if resolution % 2 == 0:
            assert n == {6.0: 12, 7.0: 120 * 7**resolution - 10}
        else:
            assert n[11.0] == 12
        corner = shapes.select(F.explode(F.slice(geo.st_vertices(F.col("g")), 1, 100)).alias("v"), "cell").select(F.round("v.x", 7).alias("x"), F.round("v.y", 7).alias("y"), "cell").distinct()
        corner = corner.where("abs(x) < 179.999").groupBy("x", "y").agg(F.count("*").alias("cells"))
        assert {r.cells for r in corner.select("cells").distinct().collect()} <= {2, 3}
    five = spark.range(122).select("id", geo.cell_shape((F.lit(8).cast("long") * 2**56) + F.col("id") * 2**45 + (2**45 - 1)).alias("g")).where(geo.st_measure("npoints", F.col("g")) == 6)
    assert sorted(r.id for r in five.collect()) == pentagons


def test_fills(spark):
    l = polygons(spark, BOX)
    assert filled(l) == {0: CENTRED}
    assert filled(l, 7, "ContainsBoundary") == {}
    assert filled(l, 7, "Covers") == {0: OVERLAPPING}
    assert filled(l, 7, "CoversBoundingBox") == {0: sorted(BOXES_OVERLAPPING)}
    assert filled(l, 6, "Covers") == {0: ["861f8ed87ffffff", "861f8ed97ffffff", "861f8edb7ffffff"]}
    out = h3.polygon_cells(l, 7)
    assert out.columns == ["id", "h3_index", "geometry"] and all(same_ring(shapes_of(out)[c], w) for c, w in HEXAGONS.items() if c in CENTRED)
    assert h3.polygon_cells(l, 6, "Covers", "cell", shapes=False).columns == ["id", "h3_index", "cell"]
    for wrong in (dict(resolution=16), dict(rule="All")):
        with pytest.raises(ValueError):
            h3.polygon_cells(l, **wrong)
    with pytest.raises(ValueError, match="longitude/latitude"):
        h3.polygon_cells(layer(l.df, "geometry", "EPSG:2056"))


@pytest.mark.parametrize("rule", h3.RULES)
def test_fills_against_all_cells(spark, rule):
    """Going down from coarse cells finds what testing every cell finds: large and small shapes, holes, parts, poles and the antimeridian."""
    round_ = "POLYGON ((" + ", ".join(f"{20 * math.cos(k / 50 * 3.14159265) + 30:.6f} {15 * math.sin(k / 50 * 3.14159265) + 10:.6f}" for k in range(100)) + ", 50 10))"
    wkts = [round_, "POLYGON ((-10 -10, 60 -10, 60 50, -10 50, -10 -10), (0 0, 0 30, 30 30, 30 0, 0 0))", "MULTIPOLYGON (((170 -20, 180 -20, 180 0, 170 0, 170 -20)), ((-180 -20, -171 -20, -171 0, -180 0, -180 -20)))", "POLYGON ((-180 70, 180 70, 180 90, -180 90, -180 70))",
            "POLYGON ((10 10, 10.1 10, 10.1 10.1, 10 10.1, 10 10))", "POINT (1 2)", "POLYGON EMPTY", None, "POLYGON ((-180 -90, 180 -90, 180 -60, 0 -85, -180 -60, -180 -90))"]
    l = polygons(spark, *wkts)
    got = filled(l, 3, rule)
    cells = spark.range(122 * 343).select(((F.lit(8).cast("long") * 2**56) + F.lit(3 << 52) + F.expr("id div 343") * 2**45 + F.expr("(id div 49) % 7") * 2**42 + F.expr("(id div 7) % 7") * 2**39 + F.expr("id % 7") * 2**36 + (2**36 - 1)).alias("cell"))
    cells = cells.where(geo.cell_shape(F.col("cell")).isNotNull())
    every = l.df.join(cells).where(F.size(geo.cell_fill(F.col("geometry"), F.col("cell"), 3, rule)) > 0).select("id", h3.cell_text(F.col("cell")).alias("c"))
    want = {}
    for r in every.collect():
        want.setdefault(r.id, []).append(r.c)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert len(got[1]) > 500 and len(got[2]) > 20


def test_inside_comes_down_whole(spark):
    l = polygons(spark, "POLYGON ((0 40, 12 40, 12 50, 0 50, 0 40))")
    got = filled(l, 6)[0]
    area = h3.polygon_cells(l, 6).df.agg(F.sum(geo.st_area(F.col("geometry")))).first()[0]
    assert len(got) > 20_000 and abs(area - 120) < 0.5
    below = spark.createDataFrame([(int("831f8dfffffffff", 16),)], "c long").select(F.explode(h3.descendants(F.col("c"), 5)).alias("d"))
    assert [r.t for r in below.select(h3.cell_text(F.col("d")).alias("t")).collect()][:2] == ["851f8d03fffffff", "851f8d07fffffff"]
    assert below.where(h3.h3_parent(F.col("d"), 3) == int("831f8dfffffffff", 16)).distinct().count() == 49


def tile(folder, name, rows, **columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{folder}/{name}"
    pq.write_table(pa.table({"value": [k / 10 for k in range(rows)], **{c: [v] * rows for c, v in columns.items()}}), path)
    return path


def test_dense_tiles(spark, tmp_path):
    own = tile(tmp_path, "0001_891f8d7a49bffff.parquet", 7)
    assert readers.dense_tile(spark, own) == ("891f8d7a49bffff", 10)
    assert readers.read(spark, own).columns == ["value", "file_row_number"]
    assert readers.read(spark, own, row_number=False).columns == ["value"]
    got = readers.read_tile(spark, own, shapes=True)
    assert got.columns == ["value", "h3_index", "geometry"] and same_ring(shapes_of(got)["8a1f8d7a49a7fff"], HEXAGONS["8a1f8d7a49a7fff"])
    assert {r.value: r.h3_index for r in readers.read_tile(spark, own).df.collect()}[0.4] == "8a1f8d7a49a7fff"
    for name, rows, more in (("tile.parquet", 7, {}), ("891f8d7a49bffff.parquet", 8, {}), ("891f8d7a49b7fff.parquet", 7, {}), ("8009fffffffffff.parquet", 7, {}), ("8f1f8d7a49a4a4a.parquet", 7, {}), ("881f8d7a49fffff.parquet", 7, {"cell": "x"})):
        path = tile(tmp_path, name, rows, **more)
        assert readers.dense_tile(spark, path) is None and "file_row_number" not in readers.read(spark, path).columns
        with pytest.raises(ValueError, match="dense tile"):
            readers.read_tile(spark, path)
    # A single row is the parent itself; a pentagon's descendants are no power of seven.
    assert readers.dense_tile(spark, tile(tmp_path, "801ffffffffffff.parquet", 1)) == ("801ffffffffffff", 0)


@pytest.mark.parametrize("format", ["GeoParquet", "GeoJSON"])
def test_cells_are_written_as_shapes(spark, tmp_path, format):
    df = spark.createDataFrame([("8a1f8d7a49a7fff", 1), (None, 2)], "h3_index string, v int")
    path = f"{tmp_path}/out"
    writers.write(layer(df), path, format)
    back = readers.read(spark, path, "geojson" if format == "GeoJSON" else "parquet")
    got = {r.v: r.w for r in back.df.select("v", geo.st_astext(F.col("geometry")).alias("w")).collect()}
    assert same_ring(got[1], HEXAGONS["8a1f8d7a49a7fff"]) and got[2] is None
    writers.write(layer(df), f"{tmp_path}/plain")
    assert readers.read(spark, f"{tmp_path}/plain").columns == ["h3_index", "v"]


def test_fills_of_many_small_polygons(spark):
    """Many small polygons of one file are filled by many tasks, and what is known of coarse cells is not worked out for each again."""
    geo.register(spark)
    k = F.col("id")
    x, y = k * 7919 % 36000 / 100 - 180, k * 104729 % 13600 / 100 - 68
    df = spark.range(60_000).coalesce(1).select("id", geo.st_box(x, y, F.least(x + 0.3, F.lit(180)), y + 0.2).alias("geometry"))
    h3.polygon_cells(layer(df.limit(9), "geometry"), 5, shapes=False).df.count()  # loads what it needs
    started = time.time()
    cells = written(h3.polygon_cells(layer(df, "geometry"), 5, shapes=False).df)
    took = time.time() - started
    cells = cells.withColumn("c", geo.cell_centre(h3.cell_number(F.col("h3_index"))))
    found = cells.join(df.withColumnRenamed("id", "own").withColumn("b", geo.st_bounds(F.col("geometry"))), F.col("id") == F.col("own"))
    inside = geo.st_x(F.col("c")).between(F.col("b.minx"), F.col("b.maxx")) & geo.st_y(F.col("c")).between(F.col("b.miny"), F.col("b.maxy"))
    n, different, good, polygons = found.agg(F.count("*"), F.count_distinct("id", "h3_index"), F.count_if(inside), F.count_distinct("id")).first()
    assert n == different == good and polygons > 57_000
    assert took < 20
