"""Hard negatives by exact inner products: Strassen's recursion on int64 tiles, then heaps that merge.

Anchors are split into groups and all rows into shards of bounded size; each group meets each shard once, in a task of
its own. There the scores of a tile of anchors and rows come from Strassen's recursion, whose sums are exact: int64
arithmetic is a ring modulo 2**64, so that a score which fits in 64 bits is right whatever happens on the way. A first
pass keeps each anchor's best rows of its own label, its positives; a second keeps the best rows of other labels inside
the window of each positive. Heaps of a tile are merged into those of the task, and those of the tasks by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import drop_written, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
WINDOW = (50, 95)
#: Rows of a shard and anchors of a group are at most about so many; with few rows there are shards for every core.
SHARD, GROUP, LEAST_SHARD = 16_384, 8_192, 512
#: Anchors and rows of a tile.
TILE = (256, 1024)
#: Strassen's recursion ends where a side has at most so many numbers.
LEAF = 16
#: No score: below all scores, whose size is less than 2**63 as the rows' lengths bound it.
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of halves; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    pad = lambda x: np.pad(x, [(0, s % 2) for s in x.shape])
    halves = lambda x: [np.ascontiguousarray(q) for rows in np.split(x, 2) for q in np.split(rows, 2, axis=1)]
    (a11, a12, a21, a22), (b11, b12, b21, b22) = halves(pad(a)), halves(pad(b))
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


class Heap:
    """The best ``k`` rows of each anchor: scores falling, and of equal scores the row that was put first."""

    def __init__(self, anchors: int, k: int) -> None:
        self.k, self.score, self.row = k, np.full((anchors, k), NONE), np.full((anchors, k), -1)

    def put(self, at: slice, scores: np.ndarray, first: int) -> None:
        """Merge a tile, which is used up: the scores of the anchors ``at`` (``NONE``: not eligible) with rows numbered from ``first``."""
        best = np.empty((len(scores), self.k), np.int64)
        lines = np.arange(len(scores))
        top = np.empty_like(best)
        for i in range(self.k):  # the first of the greatest, so that ties go to the row that comes first
            best[:, i] = scores.argmax(axis=1)
            top[:, i] = scores[lines, best[:, i]]
            scores[lines, best[:, i]] = NONE
            if (top[:, i] == NONE).all():
                top[:, i:] = NONE
                best[:, i:] = 0
                break
        both, rows = np.hstack([self.score[at], top]), np.hstack([self.row[at], np.where(top == NONE, -1, best + first)])
        # argsort is stable and keeps the older rows first; complementing reverses the order without overflow.
        order = np.argsort(~both, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.row[at] = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, len(flat) // t.num_rows)


def _ordered(rows: pa.Table) -> pa.Table:
    """By id, rows without one last, then by row number: the order of ties."""
    return rows.sort_by([("id", "ascending"), ("rid", "ascending")])  # nulls come last


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    """Slices of anchors, slices of rows, and their scores."""
    for a in range(0, len(anchors), TILE[0]):
        for r in range(0, len(rows), TILE[1]):
            yield slice(a, min(a + TILE[0], len(anchors))), slice(r, min(r + TILE[1], len(rows))), strassen(anchors[a : a + TILE[0]], rows[r : r + TILE[1]].T)


def _best_positives(anchors: pa.Table, rows: pa.Table, positives: int) -> pa.Table:
    """``aid, rid, id, score``: each anchor's best other rows of its label among ``rows``."""
    rows = _ordered(rows)
    al, rl, ar, rr = (t.column(c).to_numpy() for c in ("label", "rid") for t in (anchors, rows))
    heap = Heap(len(al), positives)
    for a, r, s in _tiles(_matrix(anchors), _matrix(rows)):
        fits = (al[a, None] == rl[None, r]) & (ar[a, None] != rr[None, r])
        heap.put(a, np.where(fits, s, NONE), r.start)
    i, k = np.nonzero(heap.row >= 0)
    took = rows.take(pa.array(heap.row[i, k]))
    return pa.table({"aid": ar[i], "rid": took.column("rid"), "id": took.column("id"), "score": heap.score[i, k]})


def _window(positive: int, window: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest score in the window of a positive's; Python's integers don't overflow."""
    return max(-((-window[0] * positive) // 100), NONE + 1), min(window[1] * positive // 100, -(NONE + 1))


def _best_negatives(anchors: pa.Table, rows: pa.Table, negatives: int, window: tuple[int, int]) -> pa.Table:
    """``aid, place, rid, id, score``: the best rows of other labels in the window of each anchor's ``place``-th positive."""
    rows = _ordered(rows)
    al, rl = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    scores = anchors.column("scores").to_pylist()
    places = max(map(len, scores), default=0)
    bounds = np.full((places, 2, len(scores)), np.int64(0))
    bounds[:, 0] = 1  # an empty window
    for i, own in enumerate(scores):
        for p, s in enumerate(own):
            bounds[p, :, i] = _window(s, window)
    heaps = [Heap(len(al), negatives) for _ in range(places)]
    for a, r, s in _tiles(_matrix(anchors), _matrix(rows)):
        other = np.where(al[a, None] != rl[None, r], s, NONE)
        for heap, (low, high) in zip(heaps, bounds, strict=True):
            heap.put(a, np.where((other >= low[a, None]) & (other <= high[a, None]), other, NONE), r.start)
    out = []
    for p, heap in enumerate(heaps):
        i, k = np.nonzero(heap.row >= 0)
        took = rows.take(pa.array(heap.row[i, k]))
        out.append(pa.table({"aid": anchors.column("rid").to_numpy()[i], "place": np.full(len(i), p + 1, np.int32), "rid": took.column("rid"), "id": took.column("id"), "score": heap.score[i, k]}))
    return pa.concat_tables(out) if out else pa.table({"aid": np.empty(0, np.int64), "place": np.empty(0, np.int32), "rid": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})


def scaled(c: Column, scale: int) -> Column:
    """Each component of a vector as ``floor(scale * component)``."""
    return F.transform(c, lambda x: F.floor(x.cast("double") * scale))


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``rid, id, label, q`` of the rows that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    # In doubles, which err by far less than the half that is left: where the squares' sum is below 2**62 no score reaches 2**63.
    short = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * SCALE + 1, 2.0)) < float(2**62)
    own = own.where(F.col("label").isNotNull() & F.coalesce(finite & short, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("rid"), "id", "label", scaled(F.col("vec"), SCALE).alias("q"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows``.

    ``rows`` has ``rid`` (unique), ``id``, ``label``, ``q`` (longs); ``anchors`` is a condition on them. A row's score is its
    inner product with the anchor; higher ones come first, and of equal ones the smaller id, rows without id last, then
    by ``rid``. An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels whose scores are between ``window``'s hundredths of its own come back. Rows that share an id,
    or are equal, are rows of their own; a vector has scores only with vectors of its own length, an empty one has 0. Anchors
    without positives, and positives without negatives, give no rows; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("d", F.size("q")), "rows")
    sizes = {r["d"]: (r["n"], r["a"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(anchors).alias("a")).collect()}
    n, a = max((n for n, _ in sizes.values()), default=0), max((a for _, a in sizes.values()), default=0)
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(-(-n // LEAST_SHARD), 4 * cores))
    groups = max(1, -(-a // GROUP))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Each group meets each shard: rows are copied to the few groups, anchors to the shards.
    dealt = rows.withColumn("g", every(groups)).withColumn("s", deal("rid", shards)).groupBy("d", "g", "s")
    asked = rows.where(anchors).select(*[F.col(c).alias(c) for c in ("rid", "label", "q", "d")])  # columns of its own beside those of ``dealt``

    def met(asking: DataFrame, run, schema: str) -> DataFrame:
        asking = asking.withColumn("g", deal("rid", groups)).withColumn("s", every(shards)).groupBy("d", "g", "s")

        def each(own: pa.Table, other: pa.Table) -> pa.Table:
            got = run(own, other) if own.num_rows and other.num_rows else None
            return got if got is not None else empty

        empty = spark.createDataFrame([], schema).toArrow()
        return asking.cogroup(dealt).applyInArrow(each, schema)

    def first(df: DataFrame, by: list[str], k: int) -> DataFrame:
        # Ranks up to k: Spark keeps no more of a key in a task before it shuffles.
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid"))
        return df.withColumn("rank", rank).where(F.col("rank") <= k)

    found = met(asked, lambda x, y: _best_positives(x, y, positives), "aid long, rid long, id long, score long")
    found = written(first(found, ["aid"], positives).select("aid", F.col("rank").alias("place"), "rid", "id", "score"), "positives")
    scores = found.groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))  # at most ``positives``
    asked = asked.join(scores, F.col("rid") == F.col("aid")).drop("aid")
    lost = met(asked, lambda x, y: _best_negatives(x, y, negatives, window), "aid long, place int, rid long, id long, score long")
    lost = first(lost, ["aid", "place"], negatives).select("aid", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("aid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = rows.where(anchors).select(F.col("rid").alias("aid"), F.col("id").alias("anchor_id"))
    out = lost.join(pairs, ["aid", "place"]).join(names, "aid")
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    drop_written(rows)
    drop_written(found)
    return out


def mined(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of a table of labelled vectors.

    Labels of ids divisible by 7 are shifted by one modulo 10, components become ``floor(256 * x)``, anchors are the ids
    divisible by 50. Rows take no part if label or vector is null, if a component is null or not finite, or if the scaled
    vector is so long (2**31) that a score might not fit in 64 bits. Other columns are not read; see ``hard_negatives``
    for ties, repeated rows and ids that are null.
    """
    rows = prepared(vectors, id_col, vec_col, label_col)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.coalesce(F.col("id") % 50 == 0, F.lit(False)))
