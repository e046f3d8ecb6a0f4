"""Sharding by sampled splitters: ranges of a key, near equal in bytes, dealt to shards in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import written

SHARDS = 8
#: Ranges for each shard, and sampled keys for each range; at most ``MOST_RANGES`` ranges, whose table is broadcast.
RANGES, SAMPLES, MOST_RANGES = 128, 16, 8192
#: A range this much larger than the mean is sampled anew and subdivided.
OVERFULL = 3.0
#: A shard may end so much of its size away from its share, if that spares cutting a group of equal texts.
LEEWAY = 0.02
_PREFIXES = 4096


def _uniform(*c: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, so that a task that runs again draws the same sample."""
    return F.shiftrightunsigned(F.xxhash64(*c), 11) / float(2**53)


def _splitters(sample: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th key of a bounded sample. Only a text that has several splitters, a large group, is cut by id."""
    s = sample.withColumn("_i", F.row_number().over(Window.orderBy("hi", "lo"))).where(F.col("_i") % step == 0)
    s = s.withColumn("_j", F.row_number().over(Window.partitionBy("hi").orderBy("lo")))
    return s.select("hi", F.when(F.col("_j") == 1, F.lit(-(2**63))).otherwise(F.col("lo")).alias("lo")).distinct()


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with ``range``: how many splitters are at or below the key (hi, lo), found through the top bits of hi."""
    spark = rows.sparkSession
    prefix = lambda c: (F.shiftright(c, 52) + _PREFIXES // 2).cast("long")
    lists = splitters.groupBy(prefix(F.col("hi")).alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("hi", "lo"))).alias("cuts"))
    table = spark.range(_PREFIXES).withColumnRenamed("id", "prefix").join(lists, "prefix", "left")
    below = F.sum(F.coalesce(F.size("cuts"), F.lit(0)).cast("long")).over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    table = table.select("prefix", F.when(F.col("cuts").isNull(), F.array().cast("array<struct<hi:bigint,lo:bigint>>")).otherwise(F.col("cuts")).alias("cuts"), F.coalesce(below, F.lit(0)).alias("below"))
    rows = rows.withColumn("prefix", prefix(F.col("hi"))).join(F.broadcast(table), "prefix")
    key = F.struct("hi", "lo")
    return rows.withColumn("range", F.col("below") + F.size(F.filter("cuts", lambda c: c <= key))).drop("prefix", "cuts", "below")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for each row, under the law ``bytes``.

    A row's size is the bytes of its text and one more. Its key is the hash of the text, then of the id, so that equal
    texts stand together. Keys are sampled by size; their quantiles are the splitters of 128 ranges a shard. The ranges
    are measured exactly, overfull ones are sampled anew and subdivided, and each shard takes a run of ranges that ends
    at its share of all bytes. A group of equal texts is cut only where it is large or a shard would else be off by
    over two percent. Slots count from 0 in the order of the key; numbering is done range by range. Null texts have size
    1 and the checksum of no bytes; null ids count as the empty text in the key; repeated rows get slots of their own;
    an empty table gives an empty table. Other columns are not read.
    """
    text, name = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hi"), F.xxhash64(name).alias("lo")
    )
    rows = written(rows, "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    ranges = min(MOST_RANGES, RANGES * shards)
    drawn = _uniform(F.col("hi"), F.col("lo"), F.lit(seed)) * max(total, 1) < F.col("size") * (ranges * SAMPLES)
    cuts = written(_splitters(rows.where(drawn).select("hi", "lo"), SAMPLES), "splitters", 1)
    sums = _ranged(rows, cuts).groupBy("range").agg(F.sum("size").alias("bytes"))
    over = sums.where(F.col("bytes") * ranges > OVERFULL * total).select("range")
    dense = _uniform(F.col("hi"), F.col("lo"), F.lit(seed + 1)) * max(total, 1) < F.col("size") * (ranges * SAMPLES * 4)
    more = _ranged(rows, cuts).join(F.broadcast(over), "range", "left_semi").where(dense).select("hi", "lo")
    cuts = written(cuts.unionByName(_splitters(more, 4 * SAMPLES // 2)).distinct(), "splitters", 1)

    rows = written(_ranged(rows, cuts), "ranged")
    table = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = cuts.withColumn("range", F.row_number().over(Window.orderBy("hi", "lo")).cast("long")).select("range", (F.col("lo") == -(2**63)).alias("whole"))
    table = table.join(starts, "range", "left").withColumn("start", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = max(total, 1) / shards
    cut = F.round(F.col("start") / each).cast("int")
    off = F.abs(F.col("start") / each - cut) + F.when(F.col("whole"), 0.0).otherwise(LEEWAY)
    chosen = table.where((cut > 0) & (cut < shards)).groupBy(cut.alias("cut")).agg(F.min_by("range", F.struct(off, "range")).alias("range")).groupBy("range").agg(F.max("cut").alias("cut"))
    table = table.join(chosen, "range", "left")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("shard", F.coalesce(F.max("cut").over(upto), F.lit(0)))
    inside = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("range", "shard", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("first"))
    out = rows.withColumn("slot", F.row_number().over(Window.partitionBy("range").orderBy("hi", "lo", "id", "crc")) - 1).join(F.broadcast(table), "range")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
