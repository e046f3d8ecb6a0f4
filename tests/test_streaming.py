from pyspark.sql import functions as F

from geoloom.functions.values import Condition
from geoloom.layer import layer
from geoloom.operators import route
from geoloom.streaming import windows


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_agree_with_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    big = lambda df: route.tester(layer(df), [Condition("value", ">", 50)])["passed"].df
    assert drained(big(stream).select("event_id"), "passed").count() == big(table).count()
    aggs = [("count", None, "n"), ("max", "value", "top")]
    want = {(r.window_start, r.event_type): (r.n, r.top) for r in windows.windowed_aggregate(table, "ts", "1 day", "1 hour", ["event_type"], aggs).collect()}
    got = {(r.window_start, r.event_type): (r.n, r.top) for r in drained(windows.windowed_aggregate(stream, "ts", "1 day", "1 hour", ["event_type"], aggs), "days", "complete").collect()}
    assert got == want
    first = drained(windows.first_of_stream(stream, ["user_id"], "ts", "1000 days"), "first")
    assert first.count() == table.select(F.count_distinct("user_id")).first()[0]
