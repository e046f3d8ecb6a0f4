"""Queries over the driver's tables that use attribute, routing, join, summary and ordering operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.values import Condition, attr, formula, sql, value
from geoloom.layer import Layer, layer
from geoloom.operators import attributes as at
from geoloom.operators import combine, geometry, h3, order, profile, route, summarise


def read(spark: SparkSession, sf_dir: str, name: str) -> Layer:
    return layer(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _ports(ports: dict[str, Layer], *columns: str) -> DataFrame:
    """All ports in one table, each row with its port's name."""
    return reduce(DataFrame.unionByName, [p.df.select(F.lit(name).alias("port"), *columns) for name, p in ports.items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, tested, as features of GeoJSON text."""
    from geoloom.sources.writers import geojson_features

    places = customers(spark, sf_dir)
    rich = route.tester(places, [Condition("c_acctbal", ">", 5000)])["passed"]
    return geojson_features(at.keep(rich, ["c_custkey", "c_name", "c_acctbal", "geometry"]))


def customers(spark: SparkSession, sf_dir: str) -> Layer:
    c = at.create(read(spark, sf_dir, "customer"), [("lon", sql("((c_custkey * 7919) % 36000) / 100.0D - 180")), ("lat", sql("((c_custkey * 104729) % 17000) / 100.0D - 85"))])
    return geometry.points(c, "lon", "lat")


def tester_and_or(spark, d):
    tests = [Condition("l_quantity", ">", 30, open=1), Condition("l_discount", "<", 0.02, join="AND", close=1), Condition("l_returnflag", "=", "R", join="OR")]
    return _ports(route.tester(read(spark, d, "lineitem"), tests), "l_orderkey", "l_linenumber")


def tester_null_failed(spark, d):
    orders = at.create(read(spark, d, "orders"), [("half", sql("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END"))])
    return _ports(route.tester(orders, [Condition("half", ">", 100000)]), "o_orderkey")


def test_filter_ports(spark, d):
    rules = [Condition("l_quantity", ">", 40), Condition("l_discount", ">=", 0.05), Condition("l_returnflag", "starts with", "N")]
    return _ports(route.test_filter(read(spark, d, "lineitem"), rules), "l_orderkey", "l_linenumber")


def attribute_filter_ports(spark, d):
    return _ports(route.attribute_filter(read(spark, d, "lineitem"), "l_returnflag", ["A", "R"]), "l_orderkey", "l_linenumber")


def keeper(spark, d):
    return at.keep(read(spark, d, "part"), ["p_name", "p_partkey"]).df


def remover(spark, d):
    return at.remove(read(spark, d, "nation"), ["n_name"]).df


def renamer(spark, d):
    return at.keep(at.rename(read(spark, d, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}), ["n_nationkey", "n_regionkey", "n_name"]).df


def creator_formula(spark, d):
    new = [("label", value("x")), ("flag", value("yes", "Boolean")), ("copy", attr("o_orderkey")), ("each", formula(attr("o_totalprice"), "÷", attr("o_orderkey"))), ("none", formula(attr("o_totalprice"), "÷", value("0", "Number"))), ("joined", formula(attr("o_orderstatus"), "join text", attr("o_orderkey")))]
    return at.keep(at.create(read(spark, d, "orders"), new), ["o_orderkey", "label", "flag", "copy", "each", "none", "joined"]).df


def creator_sql(spark, d):
    return at.create_sql(read(spark, d, "nation"), "SELECT *, n_nationkey * 2 AS twice FROM input").df


def manager_edits(spark, d):
    edits = [at.SetValue("n_name", sql("lower(n_name)")), at.Rename("n_name", "name"), at.CopyTo("name", "again"), at.Create("k", value("7", "Number")), at.Convert("n_regionkey", "Text"), at.Remove("n_nationkey"), at.Remove("missing")]
    return at.keep(at.edit(read(spark, d, "nation"), edits), ["name", "again", "k", "n_regionkey"]).df


def convert_try(spark, d):
    n = at.create(read(spark, d, "orders"), [("text", sql("CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END"))])
    return at.keep(at.edit(n, [at.CopyTo("text", "number"), at.Convert("number", "Integer")]), ["o_orderkey", "text", "number"]).df


def sql_cte(spark, d):
    return at.transform_sql(read(spark, d, "orders"), "WITH big AS (SELECT * FROM input WHERE o_totalprice > 1000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus;").df


def sql_window(spark, d):
    return at.transform_sql(read(spark, d, "orders"), "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM input").df


def sql_recursive(spark, d):
    return at.transform_sql(read(spark, d, "nation"), "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 5) SELECT k, count(*) AS nations FROM n JOIN input ON n_nationkey % k = 0 GROUP BY k").df


def _join(spark, d, kind):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    some = at.create(at.keep(o, ["o_orderkey", "o_custkey"]), [("c_name", value("order"))])
    return combine.feature_join(at.keep(c, ["c_custkey", "c_name"]), layer(some.df.withColumn("o_custkey", F.col("o_custkey") + 50)), [("c_custkey", "o_custkey")], kind)


def join_inner(spark, d):
    return _join(spark, d, "Inner")["joined"].df


def join_left(spark, d):
    return _join(spark, d, "Left")["joined"].df


def join_full(spark, d):
    return _join(spark, d, "Full")["joined"].df


def unjoined_left(spark, d):
    return _join(spark, d, "Inner")["unjoinedLeft"].df


def unjoined_right(spark, d):
    return _join(spark, d, "Inner")["unjoinedRight"].df


def union_by_name(spark, d):
    n, r = read(spark, d, "nation"), at.rename(read(spark, d, "region"), {"r_name": "n_name", "r_regionkey": "n_regionkey"})
    return at.keep(combine.union_by_name(at.keep(n, ["n_nationkey", "n_name", "n_regionkey"]), at.keep(r, ["n_name", "n_regionkey"])), ["n_nationkey", "n_name", "n_regionkey"]).df


def agg_all(spark, d):
    aggs = [("count", None, None), ("sum", "l_extendedprice", "total"), ("min", "l_quantity", None), ("max", "l_quantity", None), ("mean", "l_discount", None), ("median", "l_quantity", None), ("count distinct", "l_partkey", None)]
    return summarise.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], aggs).df.withColumn("total", F.round("total", 2)).withColumn("mean_l_discount", F.round("mean_l_discount", 8))


def _stats(spark, d, port):
    stats = ["Minimum", "Maximum", "Sum", "Mean", "Median", "Range", "Standard deviation", "Standard deviation (population)", "Total count", "Numeric count", "Value count"]
    out = summarise.statistics(read(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], stats)[port].df
    return out.select(*[F.round(c, 6).alias(c.replace("(", "").replace(")", "")) if c.startswith("l_quantity_") and t == "double" else F.col(f"`{c}`").alias(c) for c, t in out.dtypes])


def stats_summary(spark, d):
    return _stats(spark, d, "summary")


def stats_complete(spark, d):
    return _stats(spark, d, "complete").select("l_orderkey", "l_linenumber", "l_quantity_mean", "l_quantity_range", "l_quantity_value_count")


def stats_modes(spark, d):
    """Mode and median as aggregates, where values are few."""
    out = summarise.statistics(read(spark, d, "lineitem"), ["l_linestatus"], ["l_quantity"], ["Mode", "Median"])["summary"].df
    return out.select("l_linestatus", F.round("l_quantity_mode", 6).alias("l_quantity_mode"), F.round("l_quantity_median", 6).alias("l_quantity_median"))


def order_statistics(spark, d):
    """Medians and modes by ranks, of prices that hardly repeat, in groups that hold a third of all rows or more."""
    out = summarise.order_statistics(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "l_extendedprice_count", F.round("l_extendedprice_median", 6).alias("median"), F.round("l_extendedprice_mode", 6).alias("mode"))


def correlation(spark, d):
    return summarise.correlation(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).df.withColumn("r", F.round("r", 6))


def histogram(spark, d):
    return summarise.histogram(read(spark, d, "lineitem"), "l_extendedprice", 12).df.withColumns({c: F.round(c, 4) for c in ("bin_start", "bin_end")})


def unique_values(spark, d):
    return summarise.unique_values(read(spark, d, "lineitem"), "l_returnflag").df


def duplicate_ports(spark, d):
    ports = route.duplicate_filter(read(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"])
    return _ports(ports, "l_orderkey", "l_linenumber")


def coincident_points(spark, d):
    return route.eliminate_coincident_points(customers(spark, d), 20.0, ["c_custkey"]).df.select("c_custkey")


def sampler_every_nth(spark, d):
    return order.sample(read(spark, d, "orders"), "Every Nth", 7, ["o_orderkey"]).df.select("o_orderkey")


def sort_topn(spark, d):
    top = order.sort(read(spark, d, "orders"), [("o_totalprice", "DESC"), ("o_orderkey", "ASC")])
    return order.sample(top, "First N", 25).df.select("o_orderkey", "o_totalprice")


def column_profile(spark, d):
    p = profile.profile(at.keep(read(spark, d, "orders"), ["o_orderstatus", "o_custkey"]))
    return p.select("column", F.round("null_share", 6).alias("null_share"), "distinct", "min", "max", F.array_join("top", ",").alias("top"))


def column_categories(spark, d):
    return profile.categories(read(spark, d, "lineitem"), "l_returnflag", rows=None)


def column_suggestions(spark, d):
    l = read(spark, d, "orders")
    words, numbers = profile.suggestions(l, "o_orderstatus"), profile.suggestions(l, "o_custkey")
    return words.select(F.lit("o_orderstatus").alias("column"), "value", "n").unionByName(numbers.select(F.lit("o_custkey").alias("column"), "value", "n"))


def sample_rows(spark, d):
    return profile.sample(customers(spark, d), order=["c_custkey"]).select("c_custkey", "c_name", "geometry")


PARENT = "85283473fffffff"


def h3_positional(spark, d):
    o = read(spark, d, "orders").df.select("o_orderkey", (F.col("o_orderkey") % 343).cast("long").alias("file_row_number"))
    return h3.positional(layer(o), PARENT, rows=343).df


def h3_parent_rollup(spark, d):
    cells = h3_positional(spark, d).join(read(spark, d, "orders").df.select("o_orderkey", "o_totalprice"), "o_orderkey").drop("o_orderkey")
    out = h3.rollup(cells, "h3_index", 6)
    return out.select("parent", "cells", F.round("o_totalprice", 4).alias("o_totalprice"))


QUERIES = {
    f.__name__: f
    for f in (
        tester_and_or, tester_null_failed, test_filter_ports, attribute_filter_ports, keeper, remover, renamer, creator_formula, creator_sql, manager_edits, convert_try, sql_cte, sql_window,
        sql_recursive, join_inner, join_left, join_full, unjoined_left, unjoined_right, union_by_name, agg_all, stats_summary, stats_complete, stats_modes, order_statistics, correlation, histogram, unique_values, duplicate_ports,
        coincident_points, sampler_every_nth, sort_topn, column_profile, column_categories, column_suggestions, sample_rows, h3_positional, h3_parent_rollup,
    )
}

_J = "(SELECT o_orderkey, o_custkey + 50 AS o_custkey, 'order' AS c_name FROM orders)"
_BASE = (int(PARENT, 16) & ~(15 << 52)) | (8 << 52)
for _d in (6, 7, 8):
    _BASE &= ~(7 << (3 * (15 - _d)))
_CELL = f"({_BASE} | ((o_orderkey % 343) // 49 << 27) | ((o_orderkey % 343) // 7 % 7 << 24) | (o_orderkey % 343 % 7 << 21))"

ORACLES = {
    "tester_and_or": "SELECT CASE WHEN coalesce((l_quantity > 30 AND l_discount < 0.02) OR l_returnflag = 'R', false) THEN 'passed' ELSE 'failed' END AS port, l_orderkey, l_linenumber FROM lineitem",
    "tester_null_failed": "SELECT CASE WHEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END > 100000, false) THEN 'passed' ELSE 'failed' END AS port, o_orderkey FROM orders",
    "test_filter_ports": "SELECT CASE WHEN l_quantity > 40 THEN 'r0' WHEN l_discount >= 0.05 THEN 'r1' WHEN l_returnflag LIKE 'N%' THEN 'r2' ELSE 'unfiltered' END AS port, l_orderkey, l_linenumber FROM lineitem",
    "attribute_filter_ports": "SELECT CASE l_returnflag WHEN 'A' THEN 'v0' WHEN 'R' THEN 'v1' ELSE 'unfiltered' END AS port, l_orderkey, l_linenumber FROM lineitem",
    "keeper": "SELECT p_name, p_partkey FROM part",
    "remover": "SELECT * EXCLUDE (n_name) FROM nation",
    "renamer": "SELECT n_regionkey AS n_nationkey, n_nationkey AS n_regionkey, n_name FROM nation",
    "creator_formula": "SELECT o_orderkey, 'x' AS label, true AS flag, o_orderkey AS copy, o_totalprice / nullif(o_orderkey, 0) AS each, CAST(NULL AS DOUBLE) AS none, o_orderstatus || o_orderkey AS joined FROM orders",
    "creator_sql": "SELECT *, n_nationkey * 2 AS twice FROM nation",
    "manager_edits": "SELECT lower(n_name) AS name, lower(n_name) AS again, 7 AS k, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "convert_try": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS text, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS number FROM orders",
    "sql_cte": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
    "sql_window": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS k FROM orders",
    "sql_recursive": "SELECT CAST(k AS INTEGER) AS k, count(*) AS nations FROM range(1, 6) AS n(k) JOIN nation ON n_nationkey % k = 0 GROUP BY k",
    "join_inner": f"SELECT c_custkey, c.c_name, o_orderkey, o.c_name AS c_name_right FROM customer c JOIN {_J} o ON c_custkey = o_custkey",
    "join_left": f"SELECT c_custkey, c.c_name, o_orderkey, o.c_name AS c_name_right FROM customer c LEFT JOIN {_J} o ON c_custkey = o_custkey",
    "join_full": f"SELECT c_custkey, c.c_name, o_orderkey, o.c_name AS c_name_right FROM customer c FULL JOIN {_J} o ON c_custkey = o_custkey",
    "unjoined_left": f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_J} o WHERE c_custkey = o_custkey)",
    "unjoined_right": f"SELECT o_orderkey, o_custkey, c_name FROM {_J} o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "union_by_name": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region",
    "agg_all": "SELECT l_returnflag, l_linestatus, count(*) AS count_all, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, round(avg(l_discount), 8) AS mean_l_discount, CAST(median(l_quantity) AS DOUBLE) AS median_l_quantity, count(DISTINCT l_partkey) AS count_distinct_l_partkey FROM lineitem GROUP BY ALL",
    "stats_modes": "SELECT l_linestatus, round(CAST(v AS DOUBLE), 6) AS l_quantity_mode, round(m, 6) AS l_quantity_median FROM (SELECT l_linestatus, l_quantity AS v, row_number() OVER (PARTITION BY l_linestatus ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_linestatus, l_quantity) x JOIN (SELECT l_linestatus AS k, median(l_quantity) AS m FROM lineitem GROUP BY l_linestatus) y ON l_linestatus = k WHERE r = 1",
    "order_statistics": "SELECT l_returnflag, n AS l_extendedprice_count, round(m, 6) AS median, round(CAST(v AS DOUBLE), 6) AS mode FROM (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_extendedprice) AS r FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag, l_extendedprice) x JOIN (SELECT l_returnflag AS k, median(l_extendedprice) AS m, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag) y ON l_returnflag = k WHERE r = 1",
    "stats_summary": "SELECT l_returnflag, round(min(l_quantity), 6) AS l_quantity_minimum, round(max(l_quantity), 6) AS l_quantity_maximum, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, round(median(l_quantity), 6) AS l_quantity_median, round(max(l_quantity) - min(l_quantity), 6) AS l_quantity_range, round(stddev_samp(l_quantity), 6) AS l_quantity_standard_deviation, round(stddev_pop(l_quantity), 6) AS l_quantity_standard_deviation_population, count(*) AS l_quantity_total_count, count(l_quantity) AS l_quantity_numeric_count, count(DISTINCT l_quantity) AS l_quantity_value_count FROM lineitem GROUP BY l_returnflag",
    "stats_complete": "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER w, 6) AS l_quantity_mean, round(max(l_quantity) OVER w - min(l_quantity) OVER w, 6) AS l_quantity_range, d.l_quantity_value_count FROM lineitem JOIN (SELECT l_returnflag, count(DISTINCT l_quantity) AS l_quantity_value_count FROM lineitem GROUP BY l_returnflag) d USING (l_returnflag) WINDOW w AS (PARTITION BY l_returnflag)",
    "correlation": "SELECT a, b, round(r, 6) AS r, n FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount), count(*) FROM lineitem)",
    "histogram": "WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w FROM lineitem), b AS (SELECT CAST(least(11, floor((l_extendedprice - lo) / w)) AS INTEGER) AS bin, lo, w FROM lineitem, e) SELECT bin, round(any_value(lo) + bin * any_value(w), 4) AS bin_start, round(any_value(lo) + (bin + 1) * any_value(w), 4) AS bin_end, count(*) AS n FROM b GROUP BY bin",
    "unique_values": "SELECT l_returnflag AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2) AS percent FROM lineitem GROUP BY 1",
    "duplicate_ports": "SELECT CASE row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) WHEN 1 THEN 'unique' ELSE 'duplicate' END AS port, l_orderkey, l_linenumber FROM lineitem",
    "coincident_points": "SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY round((((c_custkey * 7919) % 36000) / 100.0 - 180)::DOUBLE / 20), round((((c_custkey * 104729) % 17000) / 100.0 - 85)::DOUBLE / 20)",
    "sampler_every_nth": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 7 = 0",
    "sort_topn": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "column_profile": "WITH t(c, v) AS (SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders), k AS (SELECT c, v, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS r FROM t WHERE v IS NOT NULL GROUP BY c, v), p AS (SELECT c, string_agg(v, ',' ORDER BY r) AS top FROM k WHERE r <= 5 GROUP BY c) SELECT 'o_orderstatus' AS \"column\", round(1 - count(o_orderstatus) / count(*), 6) AS null_share, count(DISTINCT o_orderstatus) AS \"distinct\", min(o_orderstatus) AS min, max(o_orderstatus) AS max, (SELECT top FROM p WHERE c = 'o_orderstatus') AS top FROM orders UNION ALL SELECT 'o_custkey', round(1 - count(o_custkey) / count(*), 6), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), (SELECT top FROM p WHERE c = 'o_custkey') FROM orders",
    "column_categories": "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "column_suggestions": "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', CAST(v AS VARCHAR), n FROM (SELECT unnest([min(o_custkey)::DOUBLE, quantile_cont(o_custkey, 0.25), quantile_cont(o_custkey, 0.5), quantile_cont(o_custkey, 0.75), max(o_custkey)::DOUBLE]) AS v, unnest(range(5)) AS n FROM orders)",
    "sample_rows": r"SELECT c_custkey, c_name, 'POINT (' || regexp_replace(CAST(((c_custkey * 7919) % 36000) / 100.0::DOUBLE - 180 AS VARCHAR), '\.0$', '') || ' ' || regexp_replace(CAST(((c_custkey * 104729) % 17000) / 100.0::DOUBLE - 85 AS VARCHAR), '\.0$', '') || ')' AS geometry FROM customer ORDER BY c_custkey LIMIT 20",
    "h3_positional": f"SELECT o_orderkey, lower(lpad(printf('%x', {_CELL}), 15, '0')) AS h3_index FROM orders",
    "h3_parent_rollup": f"SELECT ((({_CELL}) & ~(15::BIGINT << 52)) | (6::BIGINT << 52) | ((1::BIGINT << 27) - 1)) AS parent, count(*) AS cells, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1",
}
