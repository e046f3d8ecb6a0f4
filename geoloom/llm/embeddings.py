"""Embedding near-duplicates by lattice hashing.

In each of several tables, a unit vector is projected at random to eight dimensions and decoded to the nearest point of
the E8 lattice, its cell. It is filed under that cell and probes it and the neighbouring cells whose lattice points come
next nearest. Vectors that meet are verified by cosine in double precision.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.operators.components import connected_components

LEAST = 0.9
TABLES, PROBES = 5, 4
#: Lattice unit, as a multiple of the projected distance of two vectors at the threshold.
UNIT = 1.33
#: A cell's vectors are compared in blocks of about so many.
BLOCK = 1024
#: What names a block: the table, the cell, the vectors' length, and which of the cell's homes and probes.
BLOCK_KEY = ("t", "cell", "d", "h", "a")
SEED = 42


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of plus or minus 1, or all of plus or minus 1/2 with an even number of minus."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: the better of the nearest in D8 and in D8 shifted by halves."""

    def even(y: np.ndarray) -> np.ndarray:
        whole = np.rint(y)
        odd = np.flatnonzero(whole.sum(axis=1).astype(np.int64) & 1)
        off = y[odd] - whole[odd]
        worst = np.abs(off).argmax(axis=1)
        whole[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return whole

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _name(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit name of each lattice point in a table: a mix of its doubled, whole coordinates."""
    h = np.full(len(points), (table + 1) * 1_000_003 + dim, np.uint64)
    for c in np.rint(2 * points).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@functools.cache
def _tables(d: int, tables: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table a random basis of eight orthogonal directions, and an offset of the lattice."""
    rngs = [np.random.default_rng([seed, t, d]) for t in range(tables)]
    return [(np.linalg.qr(rng.normal(size=(max(d, 8), 8)))[0], rng.random(8)) for rng in rngs]


def cells(unit: np.ndarray, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For each unit vector and table, the names of the cells it probes, its own first: (rows, tables, 1 + probes)."""
    n, d = unit.shape
    scale = UNIT * np.sqrt(2 - 2 * least) * min(1.0, np.sqrt(8 / d))
    wide = np.zeros((n, max(d, 8)))
    wide[:, :d] = unit
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t, (basis, shift) in enumerate(_tables(d, tables, seed)):
        x = wide @ basis / scale + shift
        home = nearest_point(x)
        out[:, t, 0] = _name(home, t, d)
        # The distance to a neighbour home + r is least where r lies along the offset.
        along = (x - home) @ ROOTS.T
        near = np.argsort(-along, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            out[:, t, 1 + k] = _name(home + ROOTS[near[:, k]], t, d)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaling by the largest component first avoids overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _filed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From ``class, vec`` to a row for each cell that a vector is in (home) or probes."""
    for b in batches:
        sizes = np.array([len(v) for v in b.column(1)])
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            for some in np.array_split(rows, -(-len(rows) // 512)):
                part = b.take(pa.array(some))
                vecs = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)
                names = cells(_unit(vecs.astype(float)), least)
                n, tables, probes = names.shape
                at = pa.array(np.repeat(np.arange(n), tables * probes))
                t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)
                yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1)), pa.array(t), pa.array(np.tile(np.arange(probes) == 0, n * tables)), part.column(0).take(at)], ["cell", "t", "home", "class"])


def _linked(block: pa.Table, least: float) -> pa.RecordBatch | None:
    """The links of one block, whose vectors have one length: what each class gains in linked vectors, and whom it hangs on."""
    home = block.column("home").to_numpy()
    first, t = block.column("class").to_numpy(), int(block.column("t")[0].as_py())
    # A vector's row in its own cell is a home and a probe; where the cell is cut, one row of a block may be only one.
    own, asks = np.flatnonzero(home), np.flatnonzero(block.column("ask").to_numpy())
    vecs = block.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(home), -1)
    unit = _unit(vecs)
    i, j = np.nonzero(unit[asks] @ unit[own].T >= least)
    i, j = asks[i], own[j]
    keep = first[i] != first[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    some = np.unique(np.concatenate([i, j]))
    # Only vectors with links have to know their other cells.
    sig, place = cells(unit[some], least), np.zeros(len(home), np.int64)
    place[some] = np.arange(len(some))
    once, pi, pj = np.ones(len(i), bool), place[i], place[j]
    for s in range(t + 1):
        ahead = (sig[pi, s] == sig[pj, s, 0][:, None]).any(axis=1)
        back = (sig[pj, s] == sig[pi, s, 0][:, None]).any(axis=1)
        once &= ~(ahead | back) if s < t else ~(back & (first[i] > first[j]))
    n = block.column("n").to_numpy()
    gain = np.bincount(i[once], n[j[once]], len(home)) + np.bincount(j[once], n[i[once]], len(home))
    root = np.arange(len(home))
    while True:
        least_of = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least_of)
        np.minimum.at(new, j, least_of)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.RecordBatch.from_arrays([pa.array(first[some]), pa.array(first[root[some]]), pa.array(gain[some].astype(np.int64))], ["class", "root", "gain"])


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Blocks come one after the other, sorted by ``t, cell, d, h, a``; one is held at a time."""
    held: list[pa.RecordBatch] = []
    name = None

    def done() -> Iterator[pa.RecordBatch]:
        if held and (out := _linked(pa.Table.from_batches(held), least)) is not None:
            yield out

    for b in batches:
        if not b.num_rows:
            continue
        names = np.stack([b.column(c).to_numpy().astype(np.int64) for c in BLOCK_KEY], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for lo, hi in itertools.pairwise(cuts):
            if tuple(names[lo].tolist()) != name:
                yield from done()
                held, name = [], tuple(names[lo].tolist())
            held.append(b.slice(lo, hi - lo))
    yield from done()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row: other rows linked by cosine of at least ``least``.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors link only
    with those of their own length. Equal vectors are one class, compared once and counted by its size, so that copies
    make no pairs. A cell is compared in blocks; a link that shows in several tables or both ways counts where it shows
    first, which both vectors' cells tell. Cells are matched by names; vectors go to their blocks only then. Only sums and
    one edge for each vector and block leave a block. Rows with a null id keep it and name no component (one whose
    members all lack ids has none); an empty table stays empty. Links below ``least`` are never reported; the
    share of links found is a matter of tables and probes.
    """
    c = F.col("vec")
    good = F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).withColumn("vec", F.when(good, F.col("vec")))
    # A class is numbered once its table is written, so that different vectors never share a number.
    classes = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "rep", "n", F.size("vec").alias("d"), "vec"), "classes")
    filed = classes.select("class", "vec").mapInArrow(lambda it: _filed(it, least), "cell long, t int, home boolean, class long")
    filed = written(filed.join(classes.select("class", "d"), "class"), "filed") if classes.select("d").distinct().count() > 1 else written(filed.withColumn("d", F.lit(0)), "filed")
    # A home row also serves as the probe of its own cell, so homes and probes are counted apart only for the blocks.
    place = ["t", "cell", "d"]
    sizes = filed.groupBy(*place).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("asks"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    sizes = sizes.where("homes > 0 AND asks > 1").select(*place, blocks("homes").alias("hb"), blocks("asks").alias("ab"))
    dealt = filed.join(sizes, place)
    spread = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(n)).cast("int")
    dealt = dealt.withColumn("hk", spread("hb", 1)).withColumn("ak", spread("ab", 2))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # As a probe a row meets every block of homes, as a home every block of probes; where both are one block, once.
    asking = F.transform(every("hb"), lambda h: F.struct(h.alias("h"), F.col("ak").alias("a"), (F.col("home") & (h == F.col("hk"))).alias("home"), F.lit(True).alias("ask")))
    housing = F.when(F.col("home"), F.transform(F.filter(every("ab"), lambda a: a != F.col("ak")), lambda a: F.struct(F.col("hk").alias("h"), a.alias("a"), F.lit(True).alias("home"), F.lit(False).alias("ask")))).otherwise(F.array().cast("array<struct<h:int,a:int,home:boolean,ask:boolean>>"))
    dealt = dealt.select(*place, "class", F.explode(F.concat(asking, housing)).alias("at")).select(*place, "at.*", "class")
    # Only here do vectors meet the names, and leave for their blocks.
    dealt = dealt.join(classes.select("class", "n", "vec"), "class").select(*BLOCK_KEY, "home", "ask", "class", "n", "vec")
    found = dealt.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(lambda it: _compared(it, least), "class long, root long, gain long")
    found = written(found, "links")
    gains = found.groupBy("class").agg(F.sum("gain").alias("gain"))
    comps = connected_components(found, "class", "root")
    named = classes.select("class", "rep", "n", "vec").join(gains, "class", "left").join(comps, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select("vec", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, "vec", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
