"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are partitioned by their number of distinct shingles, in powers of two. An item of n shingles that a document
contains to a share of at least t lacks at most ``floor((1 - t) * n)`` of them there, so of its MinHash sketch, the
``floor((1 - t) * upper) + 1`` smallest shingle hashes for ``upper`` the largest size in its partition, all but so many
are in the document. A document is searched for in those partitions whose items are small enough for it: the sketches
there are looked up among the hashes of the whole document, however long, and every item that enough of its sketch speaks
for is then verified on the shingles themselves: no pair is lost and none is reported wrongly.

An item of fewer words than a shingle has is one shingle of its own length, partition -1; documents are hashed at such
lengths too, if there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geoloom.cluster import written
from geoloom.llm.text import let

SHINGLE = 5
LEAST = 0.8
#: Up to so many sketch entries (16 bytes each) are broadcast; larger benchmarks are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits: case, punctuation and white space don't hide a leak."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _strings(words: Column, n: int) -> Column:
    """Every shingle of n words as a string; of fewer words the empty array."""
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def shingle_strings(words: Column, n: int = SHINGLE, lengths: tuple[int, ...] = ()) -> Column:
    """The distinct shingles of an array of words, of n words and of the other lengths."""
    return let(words, lambda w: F.array_distinct(F.concat(*[_strings(w, k) for k in (n, *lengths)]) if lengths else _strings(w, n)))


def shingle_hashes(words: Column, n: int = SHINGLE, lengths: tuple[int, ...] = ()) -> Column:
    """The hashes of all shingles, made from the words' hashes and so without building strings."""

    def of(h: Column, k: int) -> Column:
        many = F.transform(F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) >= k, many).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, k) for k in (n, *lengths)]) if lengths else of(h, n))


def sketches(items: DataFrame, least: float = LEAST, n: int = SHINGLE) -> DataFrame:
    """``item, words, shingles, partition, sketch, needed`` for each different item that has a word.

    ``words`` is the length of its shingles, ``needed`` how many of the sketch a document that holds the item must have.
    """
    it = items.select("item", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    it = it.withColumn("words", F.least(F.size("w"), F.lit(n)))
    every = range(1, n + 1)
    by_length = lambda f: F.coalesce(*[F.when(F.col("words") == k, f(F.col("w"), k)) for k in every])
    it = it.select("item", "words", by_length(shingle_strings).alias("shingles"), F.array_sort(F.array_distinct(by_length(shingle_hashes))).alias("hashes"))
    it = it.withColumn("partition", F.when(F.col("words") < n, -1).otherwise(F.floor(F.log2(F.size("hashes")))).cast("int"))
    upper = F.greatest(F.pow(F.lit(2), F.col("partition") + 1) - 1, F.lit(1))
    lacks = lambda size: F.floor(F.round((1 - least) * size, 6)).cast("int")
    it = it.select("item", "words", "shingles", "partition", F.slice("hashes", 1, lacks(upper) + 1).alias("sketch"), lacks(F.size("hashes")).alias("lacks"))
    return it.select("item", "words", "shingles", "partition", "sketch", (F.size("sketch") - F.col("lacks")).alias("needed"))


def contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, n: int = SHINGLE
) -> DataFrame:
    """``id_col, item_col, n_shingles, n_shared, containment``: each document and each item that it holds to ``least``.

    Words are lower-cased runs of letters and digits. Shingles have n words and are counted once; an item of fewer
    words is one shingle, which a document holds if its words stand there in a row. Null and wordless texts hold nothing
    and are held nowhere. Rows that share an id, of documents or of items, are judged each and reported once, by their
    fullest match; null ids are kept, and judged like one id. Empty tables give an empty table. Other columns are not
    read.
    """
    d = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.col(text_col).alias("text"))
    pairs = _held(d, items, item_col, item_text, least, n)
    best = F.max_by(F.struct("n_shingles", "n_shared"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared")).alias("best")
    pairs = pairs.groupBy(F.col("id.id").alias("id"), F.col("item.id").alias("item_id")).agg(best)
    return pairs.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("best.n_shingles"), F.col("best.n_shared"), (F.col("best.n_shared") / F.col("best.n_shingles")).alias("containment"))


def _held(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, least: float, n: int) -> DataFrame:
    """``id, hash, item, n_shingles, n_shared`` from ``id`` (a struct), ``text``: a row is named by its id and its text's hash."""
    own = F.struct(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    index = written(sketches(items.select(own.alias("item"), F.col(item_text).alias("text")).distinct(), least, n), "items")
    # An item is named by the hash of its row from here on; equal hashes would only add candidates.
    index = index.withColumn("key", F.xxhash64("item"))
    lengths = tuple(sorted(r["words"] for r in index.where(F.col("words") < n).select("words").distinct().collect()))
    sketch = index.select("key", "partition", "needed", F.explode("sketch").alias("sign"))
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    d = docs.withColumn("hash", F.xxhash64("text"))
    signs = d.select("id", "hash", shingle_hashes(plain_words(F.col("text")), n, lengths).alias("signs"))
    # A document of fewer shingles than the smallest item of a partition needs can't hold any of it.
    signs = signs.select("id", "hash", F.floor(F.log2((F.size("signs") + 0.001) / least)).cast("int").alias("upto"), F.explode("signs").alias("sign"))
    met = signs.join(sketch, (signs["sign"] == sketch["sign"]) & (sketch["partition"] <= signs["upto"])).select("id", "hash", "key", "needed", sketch["sign"])
    met = met.distinct().groupBy("id", "hash", "key").agg(F.count("*").alias("met"), F.max("needed").alias("needed")).where("met >= needed")
    found = written(met.select("id", "hash", "key"), "candidates")

    wanted = found.groupBy("id", "hash").agg(F.collect_set("key").alias("keys"))
    again = d.join(wanted.withColumnsRenamed({"id": "wanted", "hash": "at"}), F.expr("id <=> wanted AND hash <=> at"))
    again = again.select("id", "hash", "keys", shingle_strings(plain_words(F.col("text")), n, lengths).alias("own")).select("id", "hash", "own", F.explode("keys").alias("key"))
    pairs = again.join(index.select("key", "item", "shingles"), "key").select("id", "hash", "item", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).alias("n_shared"))
    return pairs.where(F.col("n_shared") >= F.lit(least) * F.col("n_shingles") - 1e-9)


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item, with all their columns. Every row is judged by its own text, whatever its id."""
    name = lambda: F.struct(F.col(id_col).alias("id"))
    leaks = _held(docs.select(name().alias("id"), F.col(text_col).alias("text")), items, item_col, "text", LEAST, SHINGLE)
    leaks = written(leaks.select(F.col("id").alias("_held_id"), F.col("hash").alias("_held_hash")).distinct(), "leaks")
    # Few numbers a row, if there are few: then no text is shuffled.
    leaks = F.broadcast(leaks) if isinstance(docs.schema[id_col].dataType, NumericType) and leaks.count() <= BROADCAST_ROWS else leaks
    row = docs.select(F.struct("*").alias("_row"), name().alias("_own_id"), F.xxhash64(text_col).alias("_own_hash"))
    kept = row.join(leaks, F.expr("_own_id = _held_id AND _own_hash = _held_hash"), "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
