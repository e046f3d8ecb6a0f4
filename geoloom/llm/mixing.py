"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.llm.text import WORD, word_count

#: A source may be repeated so often at most.
REPEATS = 3
SHARDS = 8
#: Blocks are powers of two of words, so that the least target has this many, up to the longest block.
LEAST_BLOCKS, LONGEST_BLOCK = 64, 4096
#: All rows are spread by the leading digits of their keys over buckets of about so many, 4,096 at least.
BUCKET_ROWS = 1 << 16


def cycling_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, ... by the rank of a source in code point order, null last."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size, weight``.

    The targets share the sum of all sizes by weight; none exceeds ``repeats`` times its source, and what that cuts off
    is shared by weight among the others until none is above. With the sources in ascending order of the share at which
    each is full, the level is the first at which the remaining ones aren't. One row for each source: a small table.
    """
    full = F.col("source_size") * float(repeats)
    w = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    t = sources.withColumn("_total", F.sum("source_size").over(every)).withColumn("_weights", F.sum("weight").over(every))
    t = t.withColumn("_level", (F.col("_total") - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("_open", F.col("_level") * F.col("weight") <= full)
    t = t.withColumn("_level", F.min(F.when(F.col("_open"), F.struct(full / F.col("weight"), "_level"))).over(every)["_level"])
    return t.select("source", "source_size", "weight", F.least(full, F.coalesce("_level", F.lit(0.0)) * F.col("weight")).alias("target"))


def quotas(t: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source, shard, blocks, block_words``: how many blocks of a source each shard gets.

    The blocks of all shards are seats, dealt one by one to the source with the highest quotient ``target / (2 s + 1)``
    for its s seats so far, ties by source; shard k gets an equal run of the seats. A source's seats among the first n
    are within ``share * sources / 2 + 1`` of its share of n, so only the quotients around that are listed.
    """
    every = Window.partitionBy(F.lit(0))
    b = t.where("target > 0").withColumn("_sum", F.sum("target").over(every)).withColumn("_n", F.count("*").over(every))
    fine = F.floor(F.log2(F.greatest(F.min("target").over(every) / LEAST_BLOCKS, F.lit(1.0))))
    b = b.withColumn("block_words", F.least(F.lit(float(LONGEST_BLOCK)), F.pow(F.lit(2.0), fine)).cast("long"))
    seats = F.floor(F.round(F.col("_sum") / F.col("block_words")) * F.col("h") / shards).cast("long")
    b = b.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("seats", seats)
    share, slack = F.col("seats") * F.col("target") / F.col("_sum"), F.ceil(F.col("_n") * F.col("target") / F.col("_sum") / 2) + 1
    b = b.withColumn("low", F.greatest(F.floor(share) - slack, F.lit(0)).cast("long")).withColumn("high", (F.ceil(share) + slack).cast("long"))
    house = Window.partitionBy("h")
    q = b.withColumn("left", F.col("seats") - F.sum("low").over(house)).withColumn("s", F.explode(F.sequence("low", "high")))
    rank = F.row_number().over(house.orderBy((F.col("target") / (2 * F.col("s") + 1)).desc(), F.col("source").asc_nulls_last(), "s"))
    q = q.withColumn("won", (rank <= F.col("left")).cast("long")).groupBy("source", "h", "block_words").agg((F.min("low") + F.sum("won")).alias("upto"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("h")), F.lit(0))
    return q.select("source", (F.col("h") - 1).alias("shard"), (F.col("upto") - before).alias("blocks"), "block_words")


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """The md5 by which rows are ordered. Rows without an id are told apart by their text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, shards: int, repeats: int, weight) -> DataFrame:
    """``source, key, id, size, hash, start, source_size, target, upto`` for each row.

    A source's rows stand in the order of key, id, size and text hash, and ``start`` is a row's place among the source's
    words. ``upto`` has for each shard the place in those words, repeated without end, at which its blocks end.
    """
    d = docs.select(F.col(source_col).alias("source"), _key(id_col, text_col, seed).alias("key"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"))
    d = written(d, "sizes")
    # A source may hold a third of all rows: sums are made for each of its buckets, and only those stand in one order.
    digits = max(3, math.ceil(math.log(max(d.count(), 1) / BUCKET_ROWS, 16)))
    d = d.withColumn("bucket", F.substring("key", 1, digits))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("weight", weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    t = targets(sources, repeats)
    # The blocks of shard 0 come first, then those of shard 1, and so on.
    q = quotas(t, shards).withColumn("words", F.col("blocks") * F.col("block_words"))
    q = q.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("shard"))).groupBy("source").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    t = t.alias("t").join(q.alias("q"), F.expr("t.source <=> q.source"), "left")
    upto = F.transform(F.coalesce("ends", F.array_repeat(F.lit(0).cast("long"), shards)), lambda e: F.least(e, F.col("source_size") * repeats))
    t = t.select("t.source", "source_size", "target", upto.alias("upto"))
    o = offsets.alias("o").join(t.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "bucket", "offset", "source_size", "target", "upto")
    rows = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(rows), F.lit(0)))
    d = d.alias("d").join(o.alias("o"), F.expr("d.source <=> o.source AND d.bucket = o.bucket"))
    return d.select("d.source", "key", "id", "size", "hash", (F.col("start") + F.col("offset")).alias("start"), "source_size", "target", "upto")


def _copies() -> Column:
    """How often the mix takes a whole document: a copy for each round in which its middle word is in some shard's blocks."""
    quota = F.element_at("upto", -1)
    half = F.col("start") + F.floor(F.col("size") / 2)
    rounds = F.when(quota > half, F.floor((quota - half - 1) / F.col("source_size")) + 1).otherwise(0)
    return F.when(F.col("size") > 0, rounds).otherwise(0).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, shards: int = SHARDS, repeats: int = REPEATS, weight=cycling_weight) -> DataFrame:
    """``id_col, size, source_size, target, taken, copies, source, shards`` for each row.

    A source's documents stand in a seeded order (md5 of seed and id) and are cut into equal blocks of words, going
    round at most ``repeats`` times. Shard 0 takes its quota of blocks from the front of that order, shard 1 those that
    follow, and so on: ``shards`` lists ``(shard, words)`` for those that take words of the document, and ``taken`` is
    their sum, repeats counted. ``copies`` is the whole-document form, in which a document follows the blocks that hold
    its middle word. Sizes are words, 0 for null and blank texts, which are never taken. Null sources are one source,
    the last. Repeated rows are apart; rows that agree in id and text are interchangeable. An empty table, or one
    without words, takes nothing. Other columns are not read.
    """
    d = _placed(docs, id_col, text_col, source_col, seed, shards, repeats, weight)

    def overlap(lo: Column, hi: Column) -> Column:
        rounds = [F.greatest(F.least(F.col("start") + F.col("size") + F.col("source_size") * r, hi) - F.greatest(F.col("start") + F.col("source_size") * r, lo), F.lit(0)) for r in range(repeats)]
        return sum(rounds[1:], rounds[0])

    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: F.struct(h.alias("shard"), overlap(F.coalesce(F.get("upto", h - 1), F.lit(0)), F.get("upto", h)).alias("words")))
    d = d.withColumn("shards", F.filter(each, lambda e: e["words"] > 0))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda a, e: a + e["words"])
    return d.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), _copies().alias("copies"), "source", "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix as rows of ``docs``, whatever their columns: each document as often as the mix takes it, whole.

    Along a source's order the numbers of copies only fall, so that it is enough to know the last row that has one, two
    and so on: every row compares itself with those few, and no text is shuffled. Rows that agree in id and text stand
    at one place of the order and are all taken as often as the one of them that is taken most.
    """
    d = _placed(docs, id_col, text_col, source_col, seed, SHARDS, REPEATS, cycling_weight).withColumn("copies", _copies())
    at = F.struct("key", "id", "size", "hash")
    some = range(1, REPEATS + 1)
    last = written(d.where("copies > 0").groupBy("source").agg(*[F.max(F.when(F.col("copies") >= k, at)).alias(f"last{k}") for k in some]), "mix")
    own = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("own_source"), _key(id_col, text_col, seed).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False))).join(last, F.expr("own_source <=> source"))
    # Words are counted only where the key can't decide.
    here = F.struct("key", "id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    upto = lambda k: F.when(F.col("key") < F.col(f"last{k}.key"), True).when(F.col("key") > F.col(f"last{k}.key"), False).otherwise(F.coalesce(here <= F.col(f"last{k}"), F.lit(False)))
    copies = sum((upto(k).cast("int") for k in some), F.lit(0))
    out = own.select("row", F.explode(F.array_repeat(F.lit(0), copies)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
