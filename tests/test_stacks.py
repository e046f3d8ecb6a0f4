import time

from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.layer import layer
from geoloom.operators import overlay


def squares(spark, df):
    geo.register(spark)
    return layer(df.select("id", "name", geo.st_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("geometry")), "geometry")


def test_a_high_stack_is_one_shape(spark):
    """20,000 equal squares and one across their edge: three faces, and everybody's membership."""
    df = spark.range(20_001).selectExpr("id", "CAST(id % 7 AS STRING) AS name", "IF(id = 20000, 0.5D, 0D) AS x", "0D AS y", "1D AS w")
    began = time.time()
    ports = overlay.overlay(squares(spark, df), accumulate=["name"], id_attribute="id")
    got = sorted((r._overlaps, round(r.a, 9), r.name) for r in ports["output"].df.withColumn("a", geo.st_area(F.col("geometry"))).collect())
    assert got == [(1, 0.5, "1"), (20_000, 0.5, "0;1;2;3;4;5;6"), (20_001, 0.5, "0;1;2;3;4;5;6")]
    assert ports["memberships"].df.count() == 20_000 + 20_001 + 1
    assert time.time() - began < 120


def test_equal_parts_of_different_features(spark):
    """Features that share one part, or have another ring's start and direction, are told apart by the rest."""
    geo.register(spark)
    a, b = "((0 0, 1 0, 1 1, 0 1, 0 0))", "((5 5, 6 5, 6 6, 5 6, 5 5))"
    turned = "((1 1, 1 0, 0 0, 0 1, 1 1))"
    rows = [(1, f"MULTIPOLYGON ({a}, {b})"), (2, f"MULTIPOLYGON ({b}, {turned})"), (3, f"POLYGON {a}"), (4, "POLYGON ((0.5 0, 2 0, 2 1, 0.5 1, 0.5 0))")]
    l = layer(spark.createDataFrame(rows, "id int, wkt string").select("id", geo.st_geomfromtext(F.col("wkt")).alias("geometry")), "geometry")
    ports = overlay.overlay(l, id_attribute="id")
    faces = {r.face_id: (r._overlaps, round(r.a, 9)) for r in ports["output"].df.withColumn("a", geo.st_area(F.col("geometry"))).collect()}
    members = {}
    for r in ports["memberships"].df.collect():
        members.setdefault(r.face_id, set()).add(r.feature_id)
    assert sorted((*faces[f], sorted(m)) for f, m in members.items()) == [(1, 1.0, ["4"]), (2, 1.0, ["1", "2"]), (3, 0.5, ["1", "2", "3"]), (4, 0.5, ["1", "2", "3", "4"])]
    assert set(members) == set(faces)
