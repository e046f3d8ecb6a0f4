"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import drop_written, written

#: A hub has at least so many neighbours. At most so many hubs are told apart, however many edges there are.
HUB, HUBS = 256, 20_000
#: A round's table is written by a task for so many edges, and by so many tasks at least.
TASK_EDGES, LEAST_TASKS = 20_000, 16


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Label every node of an undirected edge list with the smallest node that it reaches.

    Returns ``(node, component)`` with one row for each node that is not the smallest of its component; a node that is
    absent is its own component. Each round re-hangs neighbours on the smallest node seen (large star, then small
    star) until all are stars, so that the rounds grow with the logarithm of a component's size. Edges stay linear in
    the input. Hubs are reduced by partial aggregation, and as few nodes can have many edges, their least neighbours are
    broadcast, so that a hub's edges meet theirs where they are. Null ends and loops are left out. The tables between
    rounds are written in the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    e = written(e.distinct(), "edges")
    size, stars = _state(e)
    while not stars:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        many = max(HUB, -(-2 * size // HUBS))
        hubs = F.broadcast(least.where(F.col("n") >= many).select("u", F.col("m").alias("hub")))
        split = both.where(F.col("v") > F.col("u")).join(hubs, "u", "left")
        rest = split.where("hub IS NULL").join(least.where(F.col("n") < many), "u").select("v", "m")
        large = split.where("hub IS NOT NULL").select("v", F.col("hub").alias("m")).unionByName(rest).select(F.col("v").alias("u"), F.col("m").alias("v"))
        tasks = max(LEAST_TASKS, size // TASK_EDGES)
        large = written(large.distinct(), "edges", tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        small = written(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "edges", tasks)
        drop_written(e)
        drop_written(large)
        e, (size, stars) = small, _state(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges ``u > v`` there are, and whether they are stars: each u with one v, and no v itself a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = by.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.coalesce(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int")), F.lit(0)).alias("more")).first()
    return r["n"], not r["more"]
