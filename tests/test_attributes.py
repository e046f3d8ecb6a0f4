import pytest
from pyspark.sql import functions as F

from geoloom.functions.values import Condition, attr, formula, sql, value
from geoloom.layer import find_geometry, known_crs, layer
from geoloom.operators import attributes as at
from geoloom.operators import combine, order, profile, route, summarise

PEOPLE = [(1, "Ada", "a", 10.5), (2, "Bo", "b", 3.0), (3, "Cy", "a", None), (4, "Di", None, 7.0), (5, "Eve", "c", -2.0)]


@pytest.fixture(scope="module")
def people(spark):
    return layer(spark.createDataFrame(PEOPLE, "id int, name string, cat string, v double"))


def rows(l):
    return sorted(tuple(r) for r in l.df.collect())


def ids(l):
    return sorted(r.id for r in l.df.select("id").collect())


def test_keep_remove_rename(people):
    assert at.keep(people, ["v", "id"]).columns == ["v", "id"]
    assert at.keep(people, []).columns == people.columns
    assert at.remove(people, ["v"]).columns == ["id", "name", "cat"]
    with pytest.raises(ValueError):
        at.remove(people, ["missing"])
    swapped = at.rename(people, [("name", "cat"), ("cat", "name"), ("", "x"), ("v", "")])
    assert swapped.columns == ["id", "cat", "name", "v"] and swapped.df.first()["cat"] == "Ada"


def test_create_and_formulas(people):
    new = [("t", value("x")), ("n", value("2", "Number")), ("bad", value("two", "Number")), ("", value("y")), ("b", value("no", "Boolean")), ("z", formula(attr("v"), "/", value("0", "Number"))), ("j", formula(attr("name"), "join text", attr("cat"))), ("s", sql("id + 1"))]
    out = at.create(people, new)
    assert out.columns == [*people.columns, "t", "n", "b", "z", "j", "s"]
    r = {x.id: x for x in out.df.collect()}
    assert (r[1].t, r[1].n, r[1].b, r[1].z, r[1].j, r[1].s) == ("x", 2, False, None, "Adaa", 2) and r[4].j is None


def test_edits_in_order(people):
    out = at.edit(people, [at.Rename("name", "n"), at.SetValue("n", sql("upper(n)")), at.SetValue("name", value("lost")), at.CopyTo("n", "m"), at.Convert("m", "Integer"), at.Remove("cat")])
    assert out.columns == ["id", "n", "v", "m"]
    assert {(r.n, r.m) for r in out.df.collect()} == {(n.upper(), None) for _, n, _, _ in PEOPLE}


def test_sql(people):
    out = at.create_sql(people, "WITH input2 AS (SELECT * FROM input) SELECT *, v * 2 AS w FROM input2;")
    assert out.columns[-1] == "w"
    assert at.transform_sql(people, "  ").df is people.df
    assert at.transform_sql(people, "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 3) SELECT count(*) AS c FROM n, input").df.first().c == 15
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE input"):
        with pytest.raises(ValueError):
            at.transform_sql(people, bad)
    with pytest.raises(ValueError):
        at.create_sql(people, "SELECT id FROM input")


def test_crs(people):
    assert at.set_crs(people, "epsg:2056").crs == "EPSG:2056"
    for bad in ("", "EPSG:1", "EPSG:32661", None, "+proj=nope"):
        with pytest.raises(ValueError):
            known_crs(bad)


def test_tester(people):
    ports = route.tester(people, [Condition("cat", "=", "a"), Condition("v", ">", 5, join="OR"), Condition("v", "<", 8, join="AND")])
    assert ids(ports["passed"]) == [1, 3, 4] and ids(ports["failed"]) == [2, 5]
    ports = route.tester(people, [Condition("cat", "=", "a", open=1), Condition("v", ">", 5, join="OR", close=1), Condition("v", "<", 8, join="AND")])
    assert ids(ports["passed"]) == [4]
    assert ids(route.tester(people, [])["passed"]) == [1, 2, 3, 4, 5]
    assert ids(route.tester(people, [Condition("name", "contains", "_")])["passed"]) == [1, 2, 3, 4, 5]
    for bad in ([Condition("v", ">", 1, open=1)], [Condition("v", ">", 1, close=1)], [Condition("v", ">", "many")]):
        with pytest.raises(ValueError):
            route.tester(people, bad)


def test_ports_part_the_rows(people):
    for ports in (
        route.test_filter(people, [Condition("v", ">", 5), Condition("cat", "is null"), Condition("", "=", 1)]),
        route.attribute_filter(people, "cat", ["a", "c"]),
        route.attribute_filter(people, None, ["a"]),
        route.duplicate_filter(people, ["cat"]),
        route.duplicate_filter(people, []),
    ):
        assert sorted(i for p in ports.values() for i in ids(p)) == [1, 2, 3, 4, 5]
    assert ids(route.attribute_filter(people, "cat", ["a", "c"])["unfiltered"]) == [2, 4]
    assert len(ids(route.duplicate_filter(people, ["cat"])["unique"])) == 4
    with pytest.raises(ValueError):
        route.attribute_filter(people, "cat", list("abcdefghij" * 5))


def test_joins(spark):
    left = layer(spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0), (3, "z", 7.0), (None, "n", 8.0)], "id int, name string, area double"))
    right = layer(spark.createDataFrame([(1, "p", 1.0), (3, "q", 2.0), (4, "r", 3.0), (None, "s", 4.0)], "key int, owner string, area double"))
    inner = combine.feature_join(left, right, [("id", "key")])
    assert inner["joined"].columns == ["id", "name", "area", "owner", "area_right"]
    assert rows(inner["joined"]) == [(1, "x", 5.0, "p", 1.0), (3, "z", 7.0, "q", 2.0)]
    assert {r.name for r in inner["unjoinedLeft"].df.collect()} == {"y", "n"} and {r.owner for r in inner["unjoinedRight"].df.collect()} == {"r", "s"}
    full = combine.feature_join(left, right, [("id", "key")], "Full")["joined"].df.collect()
    assert len(full) == 6 and sum(r.id is None for r in full) == 3
    with pytest.raises(ValueError):
        combine.feature_join(left, right, [])


def test_union(people, spark):
    other = layer(spark.createDataFrame([(9, True)], "id int, extra boolean"))
    out = combine.union_by_name(people, other)
    assert out.columns == [*people.columns, "extra"] and out.df.count() == 6
    with pytest.raises(ValueError):
        combine.union_by_name(people, at.set_crs(other, "EPSG:3857"))


def test_aggregates(people, spark):
    got = {r.cat: r for r in summarise.aggregate(people, ["cat"], [("sum", "v", None), ("count", None, None), ("count distinct", "name", None)]).df.collect()}
    assert (got["a"].sum_v, got["a"].count_all, got["a"].count_distinct_name) == (10.5, 2, 2)
    none = layer(people.df.limit(0))
    assert summarise.aggregate(none).df.first()["count"] == 0
    s = summarise.statistics(people, ["cat"], ["v"], ["Range", "Numeric count", "Standard deviation (population)"])
    assert s["summary"].columns == ["cat", "v_range", "v_numeric_count", "v_standard_deviation_(population)"]
    assert s["complete"].df.count() == 5 and s["complete"].columns[:4] == people.columns


def test_correlation_and_histogram(spark):
    l = layer(spark.createDataFrame([(1.0, 2.0, 9.0, 5.0), (2.0, 4.0, 7.0, 5.0), (3.0, 6.0, 8.0, 5.0), (4.0, 8.0, None, 5.0)], "a double, b double, c double, k double"))
    got = [tuple(r) for r in summarise.correlation(l, ["a", "b", "c", "k"]).df.collect()]
    assert got[0][:2] == ("a", "b") and abs(got[0][2] - 1) < 1e-12 and got[0][3] == 4
    assert [r[2] for r in got if "k" in r[:2]] == [None] * 3 and got[-1][2] is None
    v = layer(spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 4.0, 8.0, None)], "v double"))
    assert [r.n for r in summarise.histogram(v, "v", 4).df.collect()] == [2, 2, 1, 1]
    same = layer(spark.createDataFrame([(5.0,), (5.0,)], "v double"))
    assert [(r.bin, r.n) for r in summarise.histogram(same, "v").df.collect()] == [(0, 2)]
    values = [tuple(r) for r in summarise.unique_values(layer(spark.createDataFrame([("a",), ("a",), (None,)], "c string")), "c").df.collect()]
    assert values == [("a", 2, 66.67), (None, 1, 33.33)]
    with pytest.raises(ValueError):
        summarise.correlation(l, ["a"])


def test_order(people):
    assert [r.v for r in order.sort(people, [("v", "DESC")]).df.collect()] == [10.5, 7.0, 3.0, -2.0, None]
    assert [r.v for r in order.sort(people, [("v", "ASC")]).df.collect()] == [-2.0, 3.0, 7.0, 10.5, None]
    assert ids(order.sample(people, "Every Nth", 2, order=["id"])) == [2, 4]
    assert order.sample(people, "First N", 3).df.count() == 3 and order.sample(people, "First N", "x").df.count() == 5 and order.sample(people, "Random %", 0).df.count() == 5
    assert order.preview_count(people, 3) == 4
    numbered = order.numbered(people.df.repartition(3), "k", ["v"]).collect()
    assert sorted(r.k for r in numbered) == [1, 2, 3, 4, 5] and next(r.k for r in numbered if r.v is None) == 1
    assert [order.cell_step(n) for n in (1, 50_000, 50_001, 10**12)] == [1, 1, 10, 10**6]


def test_profiles(people):
    p = {r.column: r for r in profile.profile(people).collect()}
    assert abs(p["v"].null_share - 0.2) < 1e-9 and p["v"].distinct == 4 and p["cat"].top == ["a", "b", "c"] and (p["v"].min, p["v"].max) == ("-2.0", "10.5")
    assert [tuple(r) for r in profile.categories(people, "cat").collect()][0] == ("a", 2)
    assert [tuple(r) for r in profile.categories(people, "cat", rows=None).collect()][0] == ("a", 2)
    assert profile.categories(people, "name", k=3).count() == 0
    assert [float(r.value) for r in profile.suggestions(people, "v").collect()] == [-2.0, 1.75, 5.0, 7.875, 10.5]


def test_find_geometry(spark):
    df = spark.createDataFrame([("x", bytearray(b"1"), bytearray(b"2"))], "geometry string, data binary, Geom binary")
    assert find_geometry(df.schema) == "Geom" and find_geometry(df.select("geometry", "data").schema) is None


def test_profile_of_geometry_and_bytes(spark):
    from geoloom.functions import geo
    from geoloom.layer import layer

    geo.register(spark)
    df = spark.createDataFrame([(1, 2.0, bytearray(b"x"), "a" * 100), (2, 5.0, None, None), (3, None, None, "a" * 100)], "k long, x double, raw binary, t string")
    l = layer(df.withColumn("geometry", geo.st_point(F.col("x"), F.col("k"))).withColumn("geometry", F.when(F.col("x").isNotNull(), F.col("geometry"))), "geometry")
    p = {r.column: r for r in profile.profile(l).collect()}
    assert p["geometry"].extent == [2.0, 1.0, 5.0, 2.0] and p["geometry"].distinct is None and round(p["geometry"].null_share, 3) == 0.333
    assert p["raw"].min is None and p["raw"].distinct is None and round(p["raw"].null_share, 3) == 0.667
    assert (p["k"].distinct, p["k"].min, p["k"].max, p["k"].top) == (3, "1", "3", ["1", "2", "3"])
    s = profile.sample(l, rows=2, order=["k"]).collect()
    assert [r.geometry for r in s] == ["POINT (2 1)", "POINT (5 2)"] and s[0].raw == "(binary)" and s[1].raw is None and s[0].t == "a" * 80 + "…"
    none = {r.column: r for r in profile.profile(l.with_df(l.df.limit(0))).collect()}
    assert none["k"].null_share == 0 and none["k"].distinct == 0 and none["k"].top == [] and none["geometry"].extent is None


def test_duplicates_of_a_hot_key(spark):
    """Nine tenths of the rows, and all without a key, fall under one; both ports together are the rows, repeats too."""
    rows = [(k % 10 == 0 and k or 1, k % 3, "x") for k in range(500)] + [(None, 5, "y")] * 40 + [(1, 0, "x")] * 3
    df = spark.createDataFrame(rows, "key int, v int, _n string").repartition(7)
    for order in (None, ["v"], [F.desc("v")]):
        ports = route.duplicate_filter(layer(df), ["key"], order)
        unique, rest = ([tuple(r) for r in ports[p].df.collect()] for p in ("unique", "duplicate"))
        assert sorted(map(str, unique + rest)) == sorted(map(str, rows))
        assert sorted((u[0] is None, u[0] or 0) for u in unique) == sorted({(r[0] is None, r[0] or 0) for r in rows})
    assert {u[0]: u[1] for u in unique}[1] == 2 and ports["unique"].columns == ["key", "v", "_n"]


def test_order_statistics_against_the_aggregates(spark):
    """Every value different, one group with most rows, repeats, nulls, no numbers, a group without any."""
    import random
    import statistics

    rng = random.Random(3)
    rows = [("a", rng.random()) for _ in range(2001)] + [("b", float(rng.randint(0, 5))) for _ in range(400)] + [(None, v) for v in (1.0, 2.0, 2.0, 7.0)] + [("c", None), ("c", float("nan")), ("d", 4.0), ("b", None)]
    l = layer(spark.createDataFrame(rows, "g string, v double").repartition(9))
    got = {r.g: (r.v_count, r.v_median, r.v_mode) for r in summarise.order_statistics(l, "v", ["g"]).collect()}
    for g in ("a", "b", None, "d"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        most = max(own.count(v) for v in set(own)) if g != "a" else 1
        assert got[g] == (len(own), pytest.approx(statistics.median(own)), min(v for v in own if g == "a" or own.count(v) == most))
    assert got["c"] == (0, None, None) and len(got) == 5
    whole = summarise.order_statistics(l, "v").collect()
    assert len(whole) == 1 and whole[0].v_median == pytest.approx(statistics.median(v for _, v in rows if v is not None and v == v))
    assert summarise.order_statistics(l.with_df(l.df.limit(0)), "v", ["g"]).count() == 0
