import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import Condition, value
from geoloom.layer import layer
from geoloom.operators import attributes, combine, custom, geometry, h3, overlay, route, summarise, vertex
from geoloom.operators.components import connected_components
from geoloom.sources import readers, writers


@pytest.fixture(scope="module")
def shapes(spark):
    geo.register(spark)

    def make(*wkts, crs="EPSG:4326", **columns):
        rows = [(k, w, *[c[k] for c in columns.values()]) for k, w in enumerate(wkts)]
        kinds = "".join(f", {c} string" for c in columns)
        df = spark.createDataFrame(rows, f"id int, wkt string{kinds}").withColumn("geometry", geo.st_geomfromtext(F.col("wkt"))).drop("wkt")
        return layer(df, "geometry", crs)

    return make


def texts(l):
    return [r.w for r in l.df.orderBy("id").select(geo.st_astext(F.col("geometry")).alias("w")).collect()]


def areas(l):
    return [r.a for r in l.df.select(geo.st_area(F.col(l.geometry)).alias("a")).collect()]


SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


def test_row_operators(shapes):
    l = shapes(SQUARE, "LINESTRING (0 0, 2 0, 2 2)", "POINT (1 1)", None)
    assert texts(geometry.centroid(l)) == ["POINT (1 1)", "POINT (1.5 0.5)", "POINT (1 1)", None]
    assert geometry.centroid(l).columns[-1] == "geometry"
    assert texts(geometry.smooth(l))[1] == "LINESTRING (0 0, 2 0, 2 2)"
    assert texts(geometry.densify(shapes("LINESTRING (0 0, 2 0)"), 0.5)) == ["LINESTRING (0 0, 0.4 0, 0.8 0, 1.2 0, 1.6 0, 2 0)"]
    assert texts(geometry.simplify(shapes("LINESTRING (0 0, 1 0.0001, 2 0)"), 0.01)) == ["LINESTRING (0 0, 2 0)"]
    assert texts(geometry.merge_lines(shapes("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))", SQUARE))) == ["LINESTRING (0 0, 1 0, 2 0)", SQUARE]
    tilted = geometry.min_rectangle(shapes("POLYGON ((1 0, 2 1, 1 2, 0 1, 1 0))"))
    assert areas(tilted) == [pytest.approx(2)]
    assert texts(geometry.min_circle(shapes("POINT (3 4)"))) == ["POINT (3 4)"] and areas(geometry.min_circle(shapes(SQUARE)))[0] == pytest.approx(16 * 2 * 0.19509032, rel=1e-6)
    assert areas(geometry.convex_hull(shapes("MULTIPOINT ((0 0), (1 0), (0 1))", "POINT (5 5)"), "Whole layer"))[0] == pytest.approx(0.5 + 0 + 4.5)
    for bad in (lambda: geometry.simplify(l, -1), lambda: geometry.densify(l, 0), lambda: geometry.buffer(l, "x"), lambda: geometry.reproject(l, ""), lambda: geometry.centroid(layer(l.df.drop("geometry")))):
        with pytest.raises(ValueError):
            bad()


def test_sql_names(spark, shapes):
    from geoloom.operators.attributes import transform_sql

    l = shapes(SQUARE, "LINESTRING (0 0, 4 3)")
    r = transform_sql(l, "SELECT id, st_astext(st_pointonsurface(geometry)) AS p, st_area(geometry) AS a, st_length(geometry) AS n, st_isvalid(geometry) AS v, st_numgeometries(geometry) AS k, st_astext(st_pointn(geometry, 2)) AS two, st_intersects(geometry, st_point(1, 1)) AS hit, st_geometrytype(st_buffer(geometry, 1)) AS b FROM input ORDER BY id").df.collect()
    assert (r[0].p, r[0].a, r[0].v, r[0].k, r[0].two, r[0].hit) == ("POINT (1 1)", 4.0, True, 1, "POINT (2 0)", True) and (r[1].n, r[1].two, r[1].b) == (5.0, "POINT (4 3)", "Polygon")
    whole = transform_sql(l, "SELECT st_area(st_convexhull(st_unionarray(collect_list(geometry)))) AS a FROM input").df.first()
    assert whole.a == pytest.approx(7.0)


def test_bounds_and_measures(shapes):
    l = shapes(SQUARE, "POINT (5 1)")
    assert geometry.bounding_box(l).columns == ["id", "geometry", "minx", "miny", "maxx", "maxy"]
    one = geometry.bounding_box(l, "One box").df.first()
    assert (one.minx, one.miny, one.maxx, one.maxy) == (0, 0, 5, 2)
    plots = shapes("POLYGON ((8 10, 8.01 10, 8.01 10.01, 8 10.01, 8 10))", "POLYGON ((8 60, 8.01 60, 8.01 60.01, 8 60.01, 8 60))", None)
    got = geometry.geometry_attributes(plots).df.orderBy("id").collect()
    assert [None if r.area_ha is None else round(r.area_ha, 0) for r in got] == [121, 62, None] and got[0].geometry_type == "POLYGON"
    ports = route.filter_by_area(plots, 100)
    assert [[r.id for r in ports[p].df.collect()] for p in ("kept", "removed")] == [[0], [1]]
    i = geometry.inspect_geometry(shapes("POLYGON ((0 0, 1 1, 0 1, 1 0, 0 0))")).df.first().inspection
    assert not i.is_valid and i.npoints == 5
    assert geometry.check_lonlat(l).first().ok and not geometry.check_lonlat(shapes("POINT (500 0)")).first().ok
    assert {(r.type, r.n, r.invalid) for r in geometry.quality_report(plots).collect()} == {("POLYGON", 2, 0), (None, 1, 0)}


@pytest.mark.parametrize("crs", ["EPSG:3857", "EPSG:6933", "EPSG:32632", "EPSG:32733", "ESRI:54009", "+proj=aeqd +lat_0=46 +lon_0=7", "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000", "+proj=merc", "EPSG:2056"])
def test_projections_round_trip(shapes, crs):
    l = shapes("POINT (7.43863242087181 46.95108277187109)", "POINT (9.5 -12.25)")
    back = geometry.reproject(geometry.reproject(l, crs), "EPSG:4326")
    xy = [(r.x, r.y) for r in back.df.orderBy("id").select(geo.st_x(F.col("geometry")).alias("x"), geo.st_y(F.col("geometry")).alias("y")).collect()]
    near = 1e-6 if crs == "EPSG:2056" else 1e-8  # a change of ellipsoid drops the height
    assert xy == [pytest.approx((7.43863242087181, 46.95108277187109), abs=near), pytest.approx((9.5, -12.25), abs=near)]


def test_known_coordinates(shapes):
    """Published values: the UTM eastings and northings of a point, and its Web Mercator ones."""
    l = shapes("POINT (9 48)")
    xy = lambda crs: geometry.reproject(l, crs).df.select(geo.st_x(F.col("geometry")), geo.st_y(F.col("geometry"))).first()
    assert tuple(xy("EPSG:32632")) == pytest.approx((500000.0, 5316300.4), abs=500)
    bern = shapes("POINT (7.43863242087181 46.95108277187109)")
    swiss = geometry.reproject(bern, "EPSG:2056").df.select(geo.st_x(F.col("geometry")), geo.st_y(F.col("geometry"))).first()
    assert tuple(swiss) == pytest.approx((2600000.0006, 1200000.0011), abs=0.001)
    assert tuple(xy("EPSG:3857")) == pytest.approx((1001875.417, 6106854.835), abs=0.01)


def test_metric_buffers(shapes):
    l = shapes("POINT (8 47)", "POINT (20 -30)")
    for mode in ("azimuthal_equidistant", "individual_utm"):
        out = geometry.geometry_attributes(geometry.buffer(l, 1000, mode)).df
        assert [r.area_ha for r in out.collect()] == [pytest.approx(312.14, rel=0.01)] * 2
    assert areas(geometry.buffer(l, 1, "same_as_feature")) == [pytest.approx(3.1214, abs=1e-3)] * 2


def test_dissolve(shapes):
    l = shapes("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))", "POLYGON ((5 5, 6 5, 6 6, 5 6, 5 5))", None, cat=["farm", "farm", "forest", None])
    got = {r.cat: (r.parts, r.a) for r in summarise.dissolve(l, ["cat"]).df.withColumn("a", geo.st_area(F.col("geometry"))).collect()}
    assert got == {"farm": (2, 2.0), "forest": (1, 1.0), None: (1, None)}
    assert areas(summarise.dissolve(l)) == [3.0]
    both = summarise.aggregate(l, ["cat"], [("count", None, "n")], "Dissolve").df
    assert both.columns == ["cat", "n", "geometry"] and both.count() == 3


def test_coincident_points(shapes):
    l = shapes("POINT (0 0)", "POINT (0 0.000001)", "POINT (1 1)", None, None)
    assert route.eliminate_coincident_points(l).df.count() == 3


def test_spatial_join(shapes):
    points = shapes("POINT (1 1)", "POINT (2 2)", "POINT (9 9)", None)
    areas_ = shapes(SQUARE, "POLYGON ((1 1, 30 1, 30 3, 1 3, 1 1))", None)
    pairs = lambda l: sorted((r.id, r.id_right) for r in l.df.select("id", "id_right").collect())
    assert pairs(combine.spatial_join(points, areas_)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert pairs(combine.spatial_join(points, areas_, "dwithin", 7, cell=2.5)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1)]
    assert combine.spatial_join(points, areas_, how="left").df.count() == 6


def test_overlay(shapes):
    l = shapes(SQUARE, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))", "POLYGON ((10 10, 11 10, 11 11, 10 11, 10 10))", None, "POINT (0 0)", "POLYGON ((20 20, 22 22, 20 22, 22 20, 20 20))", cat=["a", "b", "c", "d", "e", "f"])
    ports = overlay.overlay(l, accumulate=["cat"], id_attribute="id")
    faces = sorted((r._overlaps, r.cat, round(r.a, 6)) for r in ports["output"].df.withColumn("a", geo.st_area(F.col("geometry"))).collect())
    assert faces == [(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0), (2, "a;b", 1.0)]
    assert sorted(r.face_id for r in ports["output"].df.collect()) == [0, 1, 2, 3] and ports["memberships"].df.count() == 5
    assert {r.id: r.rejection_code for r in ports["rejected"].df.collect()} == {3: "no_geometry", 4: "no_polygon", 5: "invalid_geometry"}
    fixed = overlay.overlay(l, invalid="Repair")
    assert fixed["rejected"].df.count() == 2 and sum(areas(fixed["output"])) == pytest.approx(10)
    twice = overlay.overlay(shapes(SQUARE, SQUARE, SQUARE, cat=["x", "x", " "]), id_attribute="cat")
    assert sorted(r.rejection_code for r in twice["rejected"].df.collect()) == ["duplicate_id", "duplicate_id", "missing_id"]
    with pytest.raises(ValueError):
        overlay.overlay(shapes(SQUARE, crs="EPSG:3857"))


def test_sliver_is_reported(shapes):
    l = shapes("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((0.000000000001 0, 1 0, 1 1, 0.000000000001 1, 0.000000000001 0))")
    ports = overlay.overlay(l)
    assert [r.rejection_code for r in ports["rejected"].df.collect()] == ["ambiguous_face"]
    with pytest.raises(ValueError):
        overlay.overlay(l, ambiguous="Fail")


def test_vertices(shapes):
    l = shapes("POINT (0 0)", "LINESTRING (0 0, 1 0)", SQUARE, None, "MULTIPOINT ((0 0), (1 1))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))")
    n = lambda x: value(str(x), "Number")
    run = lambda mode, x, y, **k: vertex.vertex(l, mode, n(x), n(y), **k)
    out = lambda ports: {r.id: r.w for r in ports["output"].df.withColumn("w", geo.st_astext(F.col("geometry"))).collect()}
    why = lambda ports: {r.id: r.rejection_code for r in ports["rejected"].df.collect()}
    add = run("Add Point", 1, 0)
    assert out(add) == {0: "LINESTRING (0 0, 1 0)", 1: "LINESTRING (0 0, 1 0)", 3: "POINT (1 0)"}
    assert why(add) == {2: "UNSUPPORTED_GEOMETRY_TYPE", 4: "UNSUPPORTED_GEOMETRY_TYPE", 5: "UNSUPPORTED_GEOMETRY_TYPE"}
    ins = run("Insert at Index", 5, 5, index=n(-2))
    assert out(ins)[1] == "LINESTRING (0 0, 5 5, 1 0)" and out(ins)[2].startswith("POLYGON ((0 0, 2 0, 2 2, 5 5, 0 2") and why(ins)[5] == "POLYGON_WITH_HOLES"
    assert out(run("Replace at Index", 7, 7, index=n(9)))[1] == "LINESTRING (0 0, 7 7)"
    assert set(why(vertex.vertex(l, "Add Point", value("x"), n(1))).values()) == {"MISSING_COORDINATE"}
    high = vertex.vertex(shapes("LINESTRING Z (0 0 10, 4 0 20)"), "Insert at Index", n(1), n(0), index=n(1))
    assert out(high)[0] == "LINESTRING Z(0 0 10, 1 0 12.5, 4 0 20)"


def test_cells(spark):
    parent = "891f8d7a49bffff"
    df = spark.range(7).selectExpr("id AS file_row_number", "id * 1.0D AS value")
    got = [r.h3_index for r in h3.positional(layer(df), parent, rows=7).df.orderBy("value").collect()]
    assert got[0] == "8a1f8d7a4987fff" and got[6] == "8a1f8d7a49b7fff" and len(set(got)) == 7
    back = spark.createDataFrame([(g,) for g in got], "c string").select(h3.cell_text(h3.h3_parent(h3.cell_number(F.col("c")), 9)).alias("p"), h3.h3_resolution(h3.cell_number(F.col("c"))).alias("r")).distinct().collect()
    assert [(r.p, r.r) for r in back] == [(parent, 10)]
    assert h3.rollup(spark.createDataFrame([(g, 2.0) for g in got], "c string, v double"), "c", 9).first()[1:] == (7, 2.0)
    with pytest.raises(ValueError):
        h3.positional(layer(df), parent, rows=5)


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, 200), (200, 100), (5, 5), (None, 3)] + [(300, k) for k in range(301, 330)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 200: 100, **{k: 300 for k in range(301, 330)}}


@pytest.mark.parametrize("format", ["GeoParquet", "GeoJSON", "Parquet", "CSV"])
def test_files_round_trip(spark, shapes, format):
    l = shapes("POINT (1 2)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.2, 5.8 5.2, 5.8 5.5, 5.5 5.2)))", "LINESTRING (0 0, 1.5 1)", "MULTIPOINT ((1 1), (2 2))", None, name=["a", "b", None, "d", "e"])
    path = f"{tempfile.mkdtemp()}/out"
    writers.write(l, path, format)
    if format == "CSV":
        back = readers.text_points(readers.read(spark, path, "csv"), "geometry")
    else:
        back = readers.read(spark, path, "geojson" if format == "GeoJSON" else "parquet")
    assert back.geometry == "geometry" and sorted(map(str, texts(back))) == sorted(map(str, texts(l)))
    assert {r.name for r in back.df.collect()} >= {"a", "b"}


def test_projected_files(spark, shapes):
    l = geometry.reproject(shapes("POINT (8 47)"), "EPSG:32632")
    path = f"{tempfile.mkdtemp()}/out"
    writers.write(l, path, "GeoParquet")
    back = readers.read(spark, path)
    assert back.crs == "EPSG:4326" and back.df.select(geo.st_x(F.col("geometry"))).first()[0] == pytest.approx(8)
    feature = json.loads(writers.geojson_features(l).first()[0])
    assert feature["crs"]["properties"]["name"] == "urn:ogc:def:crs:EPSG::32632"
    assert writers.safe_name("my file.geojson") == "my_file"


def test_collections_of_features(spark):
    path = f"{tempfile.mkdtemp()}/c.geojson"
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1, "b": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"a": 2}, "geometry": None}]}, f, indent=1)
    l = readers.read(spark, path)
    assert l.columns == ["a", "b", "geometry"] and {str(r.w) for r in l.df.select(geo.st_astext(F.col("geometry")).alias("w")).collect()} == {"POINT (1 2)", "None"}
    with open(path, "w") as f:
        json.dump({"hello": 1}, f)
    with pytest.raises(ValueError):
        readers.read(spark, path)


def test_operators_of_ones_own_and_flows(spark, shapes):
    l = shapes("POINT (1 2)", "POINT (3 4)", cat=["a", "b"])
    near = custom.define_operator("near", [custom.Param("limit", "number", 2), custom.Param("name", "text", "it's"), custom.Param("by", "column", "cat")], [("one", "SELECT * FROM {{inputs.input}} WHERE st_x(geometry) < {{params.limit}}"), ("two", "SELECT *, {{params.name}} AS label, {{params.by}} AS copy FROM {{steps.one}}")])
    assert [(r.id, r.label, r.copy) for r in near(l).df.collect()] == [(0, "it's", "a")]
    with pytest.raises(ValueError):
        near(l, other=1)
    graph = {"nodes": [{"id": "in", "operator": "source"}, {"id": "t", "operator": "test"}, {"id": "bad", "operator": "fail"}, {"id": "after", "operator": "test"}], "edges": [{"from": "in", "fromPort": "output", "to": "t", "toPort": "input"}, {"from": "in", "to": "bad"}, {"from": "bad", "to": "after"}]}
    flow = custom.Flow(graph, {"source": lambda i, p: l, "test": lambda i, p: route.tester(i["input"], [Condition("cat", "=", "a")]), "fail": lambda i, p: 1 / 0})
    ports = flow.build()
    assert ports["t", "passed"].df.count() == 1 and ports["t", "failed"].df.count() == 1
    assert set(flow.errors) == {"bad", "after"} and "blocked" in flow.errors["after"]
    with pytest.raises(ValueError):
        custom.Flow({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]}, {}).build()


def test_geoparquet_footer_is_read_by_other_tools(spark, shapes):
    import glob

    import pyarrow.parquet as pq

    l = geometry.reproject(shapes("POINT (8 47)", "POINT (9 47)", None, name=["a", "b", "c"]), "EPSG:32632")
    path = f"{tempfile.mkdtemp()}/out"
    writers.write(l.with_df(l.df.repartition(2)), path, "GeoParquet")
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) == 2 and os.path.exists(f"{path}/_SUCCESS")
    for f in files:
        entry = json.loads(pq.read_metadata(f).metadata[b"geo"])
        assert entry["primary_column"] == "geometry" and entry["columns"]["geometry"]["encoding"] == "WKB"
        assert entry["columns"]["geometry"]["crs"]["id"] == {"authority": "EPSG", "code": 32632}
    assert pq.read_table(path).num_rows == 3
    with pytest.raises(ValueError):
        writers.write(l, path, "GeoParquet")
    # A file by another tool, whose geometry has a name of its own.
    import pyarrow as pa

    wkb = bytes(l.df.where("name = 'a'").first().geometry)
    table = pa.table({"k": [1], "where": pa.array([wkb], pa.binary())}).replace_schema_metadata({"geo": json.dumps({"version": "1.0.0", "primary_column": "where", "columns": {"where": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32632}}}}})})
    other = f"{tempfile.mkdtemp()}/o.parquet"
    pq.write_table(table, other)
    back = readers.read(spark, other)
    assert back.geometry == "where" and back.df.select(geo.st_x(F.col("where"))).first()[0] == pytest.approx(8)
    assert readers.crs_of({"primary_column": "g", "columns": {"g": {"crs": None}}}) == "EPSG:4326" and readers.crs_of({}) is None


def test_geojson_names_its_system(spark, shapes):
    path = f"{tempfile.mkdtemp()}/c.geojson"
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [111319.49079327358, 0]}}]}, f)
    assert readers.read(spark, path).df.select(geo.st_x(F.col("geometry"))).first()[0] == pytest.approx(1)
    l = geometry.reproject(shapes("POINT (8 47)"), "EPSG:32632")
    out = f"{tempfile.mkdtemp()}/out"
    writers.write(l, out, "GeoJSON")
    assert readers.read(spark, out, "geojson").df.select(geo.st_x(F.col("geometry"))).first()[0] == pytest.approx(8)


def test_sql_aggregates(shapes):
    l = shapes("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))", "POINT (5 5)", None, cat=["a", "a", "b", "c"])
    out = attributes.transform_sql(l, "SELECT cat, st_area(st_union_agg(geometry)) AS a, st_astext(st_extent_agg(geometry)) AS e FROM input GROUP BY cat").df
    assert {r.cat: (r.a, r.e) for r in out.collect()} == {"a": (2.0, "POLYGON ((0 0, 0 1, 2 1, 2 0, 0 0))"), "b": (0.0, "POINT (5 5)"), "c": (None, None)}


def test_sql_union_of_many(spark):
    """A large group is united by stacks in seconds; one shape after the other took longer with every shape."""
    geo.register(spark)
    k = F.col("id")
    x, y = (k * 7919 % 360).cast("double"), (F.floor(k * 104729 / 1000) % 170).cast("double")
    df = spark.range(12_000).repartition(3).select(F.when(k % 6 == 0, "few").otherwise("many").alias("cat"), x.alias("x"), y.alias("y"))
    l = layer(df.select("cat", geo.st_box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("geometry")), "geometry")
    started = time.time()
    out = attributes.transform_sql(l, "SELECT cat, st_area(st_union_agg(geometry)) AS a FROM input GROUP BY cat").df
    got = {r.cat: r.a for r in out.collect()}
    assert time.time() - started < 90
    assert got == {r.cat: float(r.n) for r in df.groupBy("cat").agg(F.count_distinct("x", "y").alias("n")).collect()}


def test_sql_union_of_copies_and_kinds(spark):
    """Copies count once, also when they fill stacks; shapes of several kinds give what the union of their array gives."""
    geo.register(spark)
    box = "POLYGON (({0} 0, {1} 0, {1} 1, {0} 1, {0} 0))"
    wkts = {0: box.format(0, 2), 1: box.format(1, 3), 2: "LINESTRING (-1 0.5, 4 0.5)", 3: "POINT (9 9)", 4: None}
    df = spark.createDataFrame([(c, k) for c, ks in (("a", [0]), ("b", [0, 1]), ("c", [0, 2]), ("d", [0, 1, 2, 3, 4]), ("e", [3]), ("f", [4])) for k in ks], "cat string, k int")
    df = df.join(spark.createDataFrame(list(wkts.items()), "k int, wkt string"), "k").select("cat", F.explode(F.sequence(F.lit(1), F.lit(1700))), geo.st_geomfromtext(F.col("wkt")).alias("geometry"))
    l = layer(df.repartition(3).select("cat", "geometry"), "geometry")
    out = attributes.transform_sql(l, "SELECT cat, st_union_agg(geometry) AS u, st_unionarray(collect_set(geometry)) AS v FROM input GROUP BY cat").df
    got = {r.cat: r for r in out.select("cat", geo.st_area(F.col("u")).alias("a"), F.col("u").isNull().alias("none"), geo.st_astext(geo.st_shape("normal", F.col("u"))).alias("u"), geo.st_astext(geo.st_shape("normal", F.col("v"))).alias("v")).collect()}
    assert {c: (r.a, r.none) for c, r in got.items()} == {"a": (2.0, False), "b": (3.0, False), "c": (2.0, False), "d": (3.0, False), "e": (0.0, False), "f": (None, True)}
    assert all(r.u == r.v for r in got.values())


def test_dissolve_in_stacks(spark, monkeypatch):
    """A group of many shapes, a third of them in one place, is united by stacks; copies count as parts."""
    monkeypatch.setattr(summarise, "STACK", 7)
    geo.register(spark)
    df = spark.range(300).select("id", F.when(F.col("id") < 250, "x").alias("cat"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    l = layer(df.select("id", "cat", geo.st_box(F.col("k"), F.lit(0), F.col("k") + 1, F.lit(1) + F.when(F.col("k") == 0, F.col("id") / 1000).otherwise(0)).alias("geometry")), "geometry")
    got = {r.cat: (r.parts, r.a) for r in summarise.dissolve(l, ["cat"]).df.withColumn("a", geo.st_area(F.col("geometry"))).collect()}
    assert got["x"] == (250, pytest.approx(50 + 0.249)) and got[None][0] == 50
    assert summarise.dissolve(l).df.first().parts == 300
    none = summarise.dissolve(l.with_df(l.df.limit(0)))
    assert [(r.parts, r.geometry) for r in none.df.collect()] == [(0, None)] and summarise.dissolve(l.with_df(l.df.limit(0)), ["cat"]).df.count() == 0


def test_inspection_of_rings(shapes):
    l = shapes("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 0 2, 2 2, 1 1, 0 0))", "POINT Z (1 2 3)", "LINESTRING (0 0, 1 1)", None)
    i = [r.inspection for r in geometry.inspect_geometry(l).df.orderBy("id").collect()]
    assert [(x.is_ring, x.ring_closed, x.is_convex, x.winding) for x in i[:2]] == [(True, True, True, "counter-clockwise"), (True, True, True, "clockwise")]
    assert i[2].has_z and not i[2].has_m and i[2].winding is None and i[2].is_convex is None and i[2].wkt.startswith("POINT Z")
    assert i[3].is_ring is None and i[4].type is None and i[4].wkt is None


def test_saved_flows(spark, shapes):
    l = shapes("POINT (1 1)", "POINT (2 2)", cat=["a", "b"])
    graph = {"nodes": [{"id": "s", "operator": "source"}, {"id": "t", "operator": "test"}, {"id": "x", "operator": "fail"}, {"id": "u", "operator": "all"}], "edges": [{"from": "s", "to": "t"}, {"from": "s", "to": "x"}, {"from": "x", "to": "u"}]}
    known = {"source": lambda i, p: l, "test": lambda i, p: route.tester(i["input"], [Condition("cat", "=", "a")]), "fail": lambda i, p: 1 / 0, "all": lambda i, p: i["input"]}
    flow = custom.Flow.from_json(json.dumps(graph), known)
    d = tempfile.mkdtemp()
    said = flow.run(writers.write, [{"from": "t", "fromPort": "passed", "path": f"{d}/a"}, {"from": "u", "path": f"{d}/b"}, {"from": "s", "path": f"{d}/c", "format": "CSV"}])
    assert said[f"{d}/a"] == said[f"{d}/c"] == "written" and said[f"{d}/b"].startswith("ValueError: blocked by x")
    assert spark.read.parquet(f"{d}/a").count() == 1
    assert custom.Flow.from_json(flow.to_json(), known).order() == flow.order()
    for broken in ({"nodes": [{"id": "a", "operator": "no"}]}, {"nodes": [{"id": "a", "operator": "source"}], "edges": [{"from": "a", "to": "b"}]}):
        with pytest.raises(ValueError):
            custom.Flow.from_json(json.dumps(broken), known)


@pytest.mark.parametrize("tile", [4, 15])
def test_tiled_overlay_is_the_whole_one(shapes, monkeypatch, tile):
    """Boxes, rings and copies, many in one corner, with one that covers everything: tiles give the same faces."""
    import random

    rng = random.Random(7)
    wkts = ["POLYGON ((0 0, 12 0, 12 12, 0 12, 0 0))", "POLYGON ((1 1, 11 1, 11 11, 1 11, 1 1), (2 2, 10 2, 10 10, 2 10, 2 2))"]
    for k in range(30):
        x, y = (rng.random() * (3 if k % 2 else 11) for _ in range(2))
        w, h = rng.random() * 2 + 0.1, rng.random() * 2 + 0.1
        wkts.append(f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))")
    wkts += [wkts[5]] * 3 + ["POLYGON ((20 20, 21 20, 21 21, 20 20))"]

    def faces():
        ports = overlay.overlay(shapes(*wkts, name=[str(k) for k in range(len(wkts))]), accumulate=["name"])
        rows = ports["output"].df.withColumn("a", geo.st_area(F.col("geometry"))).withColumn("x", geo.st_x(geo.st_centroid(F.col("geometry")))).collect()
        return sorted((r.name, r._overlaps, round(r.a, 7), round(r.x, 6)) for r in rows), ports["rejected"].df.count()

    whole = faces()
    monkeypatch.setattr(overlay, "TILE", tile)
    assert faces() == whole and len(whole[0]) > 60
