import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.layer import layer
from geoloom.operators import combine


def boxes(spark, rows, name):
    geo.register(spark)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], f"{name} int, a double, b double, c double, d double")
    return layer(df.select(name, geo.st_box(*[F.col(c) for c in "abcd"]).alias("geometry")), "geometry")


def mixed(rng, n):
    """Points, crumbs, fields and continents."""
    out = []
    for _ in range(n):
        size = rng.choice([0, 0, 1e-4, 0.01, 0.3, 2, 20, 150])
        x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
        out.append((x, y, x + size * rng.uniform(0.5, 1), y + size * rng.uniform(0.5, 1)))
    return out


def apart(p, q):
    dx, dy = max(p[0] - q[2], q[0] - p[2], 0), max(p[1] - q[3], q[1] - p[3], 0)
    return (dx * dx + dy * dy) ** 0.5


@pytest.mark.parametrize(("predicate", "distance"), [("intersects", None), ("dwithin", 0.05), ("dwithin", 7.0)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_sizes_of_all_kinds(spark, predicate, distance, how):
    rng = random.Random(4)
    p, q = mixed(rng, 120), mixed(rng, 90)
    q += [p[3], p[5], (*p[0][:2], *p[0][:2]), (-180, -90, 180, 90)]
    got = combine.spatial_join(boxes(spark, p, "i"), boxes(spark, q, "j"), predicate, distance, how).df.select("i", "j").collect()
    want = {(i, j) for i, a in enumerate(p) for j, b in enumerate(q) if apart(a, b) <= (distance or 0)}
    if how == "left":
        want |= {(i, None) for i in range(len(p)) if not any(k == i for k, _ in want)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_continent_among_points(spark):
    """A wide envelope isn't cut into the squares of small ones: each row is filed in a few."""
    rng = random.Random(5)
    points = [(x, y, x + 1e-5, y + 1e-5) for x, y in ((rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(2000))]
    l, r = boxes(spark, points, "i"), boxes(spark, [(-10, -10, 60, 60), *points[:20]], "j")
    wide = l.df.select("*", geo.st_bounds(F.col("geometry")).alias("_b")).withColumn("_l", combine._level(0.0))
    assert combine._filed(wide, 0.0, -20, [4], home=True).count() <= 2000 * 5
    big = r.df.select("*", geo.st_bounds(F.col("geometry")).alias("_b")).withColumn("_l", combine._level(0.0)).where("j = 0")
    assert combine._filed(big, 0.0, -20, [], home=True).count() <= 4
    got = combine.spatial_join(l, r).df.groupBy("j").count().collect()
    assert {x.j: x["count"] for x in got} == {0: 2000, **{k: 1 for k in range(1, 21)}}


def test_nothing_to_meet(spark):
    l, r = boxes(spark, [(0, 0, 1, 1)], "i"), boxes(spark, [], "j")
    assert combine.spatial_join(l, r).df.count() == 0 and combine.spatial_join(l, r, how="left").df.collect()[0].j is None
    none = l.with_df(l.df.withColumn("geometry", F.lit(None).cast("binary")))
    assert combine.spatial_join(none, l.with_df(l.df.withColumnRenamed("i", "j"))).df.count() == 0
    with pytest.raises(ValueError):
        combine.spatial_join(l, r, "touches")


@pytest.mark.parametrize(("copied", "predicate", "distance"), [("both", "intersects", None), ("left", "dwithin", 1.5), ("right", "intersects", None), ("one", "intersects", None)])
def test_copies_meet_as_one(spark, monkeypatch, copied, predicate, distance):
    """Rows of equal shapes find the same partners as rows do one by one, with what is measured of both shapes."""
    monkeypatch.setattr(combine, "PAIRS", 500)
    geo.register(spark)
    n = {"both": (400, 300, 20, 15), "left": (400, 60, 20, 60), "right": (60, 400, 60, 20), "one": (2500, 40, 1, 1)}[copied]

    def side(rows, different, name):
        k = F.col("k")
        x, y, w = k * 7 % 40, k * 11 % 30, k % 5 + 1
        shape = F.when(F.col(name) % 17 == 3, F.lit(None).cast("binary")).when(F.col(name) % 17 == 4, geo.st_geomfromtext(F.lit("POLYGON EMPTY"))).otherwise(geo.st_box(x, y, x + w, y + w))
        df = spark.range(rows).select(F.col("id").alias(name), (F.col("id") % different).alias("k"), "id")
        return layer(df.select(name, shape.alias("g"), "k"), "g")

    l, r = side(n[0], n[2], "i"), side(n[1], n[3], "j")
    got = combine.spatial_join(l, r, predicate, distance, "left", measures={"shared": lambda a, b: geo.st_area(geo.st_intersection(a, b))})
    assert got.columns == ["i", "g", "k", "j", "g_right", "k_right", "shared"]
    a, b = F.col("l.g"), F.col("r.g")
    meets = geo.st_intersects(a, b) if predicate == "intersects" else geo.st_distance(a, b) <= distance
    there = lambda c: c.isNotNull() & (geo.st_measure("is_empty", c) == 0)
    want = l.df.alias("l").join(r.df.alias("r"), there(a) & there(b) & meets, "left").select("i", "j", "l.k", F.col("r.k").alias("k_right"), geo.st_area(geo.st_intersection(a, b)).alias("shared"))
    rows = sorted(want.collect(), key=str)
    assert sorted(got.df.select("i", "j", "k", "k_right", "shared").collect(), key=str) == rows and len(rows) > 500
    inner = combine.spatial_join(l, r, predicate, distance)
    assert inner.df.select("i", "j").exceptAll(want.where("j IS NOT NULL").select("i", "j")).isEmpty() and inner.df.count() == want.where("j IS NOT NULL").count()


def test_copies_are_tested_once(spark):
    """Thousands of copies make millions of pairs, but few of shapes are tested and measured."""
    geo.register(spark)
    k = F.col("id") % 10
    l = layer(spark.range(2000).select(F.col("id").alias("i"), geo.st_box(k, k, k + 3, k + 3).alias("g")), "g")
    r = layer(l.df.select(F.col("i").alias("j"), F.col("g").alias("h")), "h")
    out = combine.spatial_join(l, r, measures={"shared": lambda a, b: geo.st_area(geo.st_intersection(a, b))}).df
    assert out.agg(F.count("*"), F.sum("shared")).first()[:] == (200 * 200 * 58, 40_000.0 * (90 + 2 * 9 * 4 + 2 * 8 * 1))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "geo_compare" not in plan and "geo_combine" not in plan  # they are done, for classes
