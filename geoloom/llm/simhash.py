"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint of 64 bits is cut into a ring of four segments. If two fingerprints differ in at most two bits, then some
start on the ring has a chain in which the first l segments together differ in at most ``l * 2 / 4`` bits for every
length l: none in the first segment, one in the first two, one in the first three, two in all four. So the first segment
is equal, and the second or the third is equal as well: each fingerprint is filed under its six pairs of segments, pairs
that meet must have such a chain, and only those reach the full Hamming check.

Two bits are a strict measure: texts that share 80 percent of their five-word shingles differ in about seven. The
pipeline therefore also links by similarity: the signs that make a fingerprint are taken from more hashes, 1,600 in all,
texts that agree in one of 64 bands of 25 signs are candidates, and the similarity of their shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geoloom.cluster import drop_written, written
from geoloom.operators.components import connected_components

SEGMENTS, BITS = 4, 16
LIMIT = 2
#: Slots of the index: the two segments that two linked fingerprints share.
PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]
#: Up to so many fingerprints of a slot are compared in pairs; fuller slots are linked through one-bit neighbours.
FULL = 32

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


#: Signs for similarity: 25 words of 64, read as 64 bands of 25 bits.
WIDE, BANDS = 25, 64
#: Similarity is that of the whole sets of shingles of so many words.
SIMILAR_SHINGLE = 5
#: Groups come together in rounds that look at these ranges of bands, the first of them while most still have to.
ROUNDS = ((0, 8), (8, BANDS))
#: All pairs of a band's bucket are candidates up to so many different shingle sets; fuller ones are joined by shingles.
PAIRED = 16
#: Tables of a few numbers a row are sent to all tasks up to so many rows, some 10 MB; the texts and sets stay where they are.
SENT = 400_000
_ODD = np.random.default_rng(42).integers(0, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; of fewer words that of the whole sequence."""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _five(h: np.ndarray) -> np.ndarray:
    """The set of five-word shingles, from the hashes of those of three: the one at a word and the one two words on tell all five.

    Of fewer words there is one, the whole sequence.
    """
    last = min(SIMILAR_SHINGLE - 3, len(h) - 1)
    mixed = h[: len(h) - last] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += h[last:]
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signs(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The fingerprint and the 64 band keys of a text, from the hashes of its shingles.

    A sign is set if its bit is in over half the hashes. The fingerprint's are of the hashes themselves, the others of
    their mixes with fixed numbers.
    """
    counts = np.zeros((WIDE + 1) * 64, np.int64)
    for some in np.array_split(h, -(-len(h) // 4096)):
        wide = np.empty((len(some), WIDE + 1), np.uint64)
        wide[:, 0] = some
        np.multiply(some[:, None], _ODD, out=wide[:, 1:])
        wide[:, 1:] ^= wide[:, 1:] >> np.uint64(32)
        octets = wide.astype("<u8", copy=False).view(np.uint8)
        size = octets.shape[1] * 256
        flat = np.bincount((octets + np.arange(0, size, 256, dtype=np.int32)).ravel(), minlength=size)
        counts += (flat.reshape(-1, 256) @ _BITS_OF_BYTE).ravel()
    over = 2 * counts > len(h)
    keys = (np.arange(BANDS, dtype=np.int64) << WIDE) | (over[64:].reshape(BANDS, WIDE) @ (1 << np.arange(WIDE, dtype=np.int64)))
    return int(np.packbits(over[:64], bitorder="little").view("<u8")[0]), keys


def bands(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's fingerprint, its 64 band keys, and the set of its five-word shingles: sorted 64-bit hashes."""
    words = _words(text)
    if not words:
        return 0, np.arange(BANDS, dtype=np.int64) << WIDE, np.zeros(0, np.uint64)
    h = _shingles(words, 3, 42)
    return *signs(h), _five(h)


def shingle_set(text: str | None) -> np.ndarray:
    """The set of a text's five-word shingles: sorted 64-bit hashes; of a null or blank text none."""
    words = _words(text)
    return _five(_shingles(words, 3, 42)) if words else np.zeros(0, np.uint64)


def _name(shingles: np.ndarray) -> int:
    """The hash that names a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 42)).astype(np.int64))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows))


def banded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash, fp, keys, name, size`` of each row, in one pass over the texts.

    ``hash`` is that of the text, ``fp`` its fingerprint, ``keys`` its signs by band, ``name`` and ``size`` those of its
    shingle set.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            got = [bands(t.as_py()) for t in b.column(2)]
            fps = pa.array(np.array([f for f, _, _ in got], np.uint64).view(np.int64))
            keys = pa.array([(k & (2**WIDE - 1)).astype(np.int32) for _, k, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, keys, pa.array([_name(s) for _, _, s in got], pa.int64()), pa.array([len(s) for _, _, s in got], pa.int32())], ["id", "hash", "fp", "keys", "name", "size"])

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, hash long, fp long, keys array<int>, name long, size int")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``name, shingles`` of the rows that ``wanted`` names: by ``id, hash``, with the ``name`` that their set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            got = [shingle_set(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_name(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["wanted", "name", "shingles"])

    own = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"), F.col(text_col).alias("text"))
    wanted = _sent(wanted, isinstance(wanted.schema["id"].dataType, NumericType))
    sets = own.join(wanted, F.expr("own_id <=> id AND own_hash = hash")).select("name", "text").mapInArrow(run, "wanted long, name long, shingles array<long>")
    return sets.where("wanted = name").select("name", "shingles")


def similar_sets(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float, known: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: links that join all shingle sets, by name, which share a band and are similar to ``least``.

    ``rows`` is what ``banded`` found in ``docs``. Every pair that shares a bucket is either compared on the whole sets or
    already joined by other links, also by those that are ``known`` (``a, b``, names). In each bucket, in rounds over more
    and more of the bands, every set that is in another component is compared with the first: that joins groups of
    copies by links that grow with their members, not with their pairs. What then is in different components is compared
    all with all in buckets of at most ``PAIRED`` sets, and in fuller ones through the rare shingles that similar sets
    must share.
    """
    first = F.min_by(F.struct("id", "hash", "size", "keys"), F.struct("id", "hash")).alias("row")
    sets = written(rows.groupBy("name").agg(first).select("name", "row.*"), "sets")
    filed = sets.select("name", "size", F.posexplode("keys").alias("band", "signs"))
    filed = filed.select("name", "size", "band", F.shiftleft(F.col("band").cast("long"), WIDE).bitwiseOR(F.col("signs").cast("long")).alias("key"))
    met = filed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("name", "size")).alias("first")).where("n > 1")
    buckets = written(filed.join(met, "key"), "buckets")
    # Written, so that its true size decides whether it goes to the texts, or they to it.
    wanted = written(sets.join(buckets.select("name").distinct(), "name", "left_semi").select("id", "hash", "name"), "wanted")
    drop_written(sets)
    shingles = written(shingle_sets(docs, id_col, text_col, wanted), "shingles")
    if shingles.count() > wanted.count():  # rows that agree in id and text
        again, shingles = shingles, written(shingles.dropDuplicates(["name"]), "shingles")
        drop_written(again)
    drop_written(wanted)

    links = known
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    for low, high in ROUNDS:
        comps = _components(links)
        star = buckets.where((F.col("band") >= low) & (F.col("band") < high) & (F.col("name") != F.col("first.name"))).where(fits(F.col("size"), F.col("first.size")))
        pairs = star.select(F.col("first.name").alias("a"), F.col("name").alias("b")).distinct()
        found = _similar(_apart(pairs, comps), shingles, least)
        links = found if links is None else links.unionByName(found)
    parts = _labelled(buckets.select("key", "name", "size", "n"), _components(links))
    split = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    parts = written(parts.join(split, "key", "left_semi"), "parts")
    drop_written(buckets)
    few = parts.where(F.col("n") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "size", "part"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "x"))
    apart = F.filter(F.slice("all", F.col("i") + 2, PAIRED), lambda y: (y["part"] != F.col("x.part")) & fits(F.col("x.size"), y["size"]))
    few = few.select(F.col("x.name").alias("a"), F.explode(apart).alias("y")).select("a", F.col("y.name").alias("b")).distinct()
    out = links.unionByName(_similar(few, shingles, least))
    full = parts.where(F.col("n") > PAIRED)
    if not full.isEmpty():
        out = out.unionByName(_meeting(full, shingles, least))
    # The links are tables of their own by now.
    for table in (shingles, parts):
        drop_written(table)
    return out


def _components(links: DataFrame | None) -> DataFrame | None:
    return None if links is None else connected_components(links, "a", "b")


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with ``part``, the component of their ``name``."""
    if comps is None:
        return rows.withColumn("part", F.col("name"))
    return rows.join(comps, F.col("name") == F.col("node"), "left").withColumn("part", F.coalesce("component", "name")).drop("node", "component")


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are in different components."""
    if comps is None:
        return pairs
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")


def similar_links(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b)``: ids, links that join all texts which share a band and whose five-word shingle sets are similar to ``least``.

    Texts of equal shingle sets are one class, which its least id stands for. Null ids are left out.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    rows = written(banded(docs, id_col, text_col), "bands")
    classes = rows.groupBy("name").agg(F.min("id").alias("rep"))
    copies = rows.select("id", "name").join(classes, "name").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = similar_sets(rows, docs, id_col, text_col, least)
    a, b = classes.select(F.col("name").alias("a"), F.col("rep").alias("ra")), classes.select(F.col("name").alias("b"), F.col("rep").alias("rb"))
    apart = found.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return apart.unionByName(copies).distinct()


def _sent(df: DataFrame, numbers: bool = True) -> DataFrame:
    """A written table of a few numbers a row, to be sent to all tasks if it has at most ``SENT`` rows; else as it is."""
    return F.broadcast(df) if numbers and df.count() <= SENT else df


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole sets are similar to ``least``, as a table of their own.

    The set of b goes to that of a, of which there should be fewer; only sets that pairs name move.
    """
    pairs = written(pairs, "pairs")
    to = sets.join(_sent(pairs), F.col("name") == F.col("b")).select("a", "b", F.col("shingles").alias("sb"))
    heads = written(pairs.select("a").distinct(), "heads")
    heads_sets = sets.join(_sent(heads), F.col("name") == F.col("a"), "left_semi").select(F.col("name").alias("a"), F.col("shingles").alias("sa"))
    both = to.join(heads_sets, "a").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    out = written(both.where(F.col("shared") >= least * (F.size("sa") + F.size("sb") - F.col("shared")) - 1e-9).select("a", "b"), "similar")
    drop_written(pairs)
    drop_written(heads)
    return out


def _meeting(full: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that join the full buckets' sets (``name, part``) of different parts, no similar pair left apart.

    Each set is ordered by how many of the sets hold a shingle, rare ones first. The first shingle that two similar sets
    share has at least ``least / (1 + least)`` of their sizes' sum from it on in both, so that it is among the first
    ``1 - least`` of either; sets of one template, whose own shingles come first, don't meet there. Under a shingle, sets
    of other parts are compared with its first, and parts that this joins are one from then on. Only what is apart after
    that is paired, part by part, so that the members of one part are never paired with each other.
    """
    names = written(full.select("name", "part").distinct(), "names")
    held = written(sets.join(_sent(names), "name").select("name", "part", F.size("shingles").alias("size"), F.explode("shingles").alias("h")), "held")
    common = held.groupBy("h").agg(F.count("*").alias("sets"), F.min("part").alias("p"), F.max("part").alias("q")).where("sets > 1")
    rows = held.join(common.select("h", "sets"), "h").groupBy("name", "part", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "h"))).alias("hs"))
    # Shingles that no other set holds come first, and are only counted.
    rows = rows.select("name", "part", "size", (F.col("size") - F.size("hs")).alias("alone"), F.posexplode("hs").alias("i", "e"))
    rows = rows.select("name", "part", "size", (F.col("size") - F.col("alone") - F.col("i")).alias("rest"), F.col("e.h").alias("h"))
    prefixes = rows = written(rows.where(F.col("rest") >= least * F.col("size") - 1e-9), "prefixes")
    drop_written(held)
    meets = lambda x, y: F.least(x("rest"), y("rest")) >= least / (1 + least) * (x("size") + y("size")) - 1e-9
    own = lambda c: F.col(c)

    first = rows.groupBy("h").agg(F.min(F.struct("name", "part", "size", "rest")).alias("first"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("h", "first")
    star = rows.join(first, "h").where((F.col("part") != F.col("first.part")) & meets(own, lambda c: F.col(f"first.{c}")))
    found = _similar(star.select(F.col("first.name").alias("a"), F.col("name").alias("b")).distinct(), sets, least)
    of = lambda c: names.select(F.col("name").alias(c), F.col("part").alias(f"p{c}"))
    joined = _components(found.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    rows = rows.withColumnRenamed("part", "was").join(joined, F.col("was") == F.col("node"), "left").select("name", "size", "rest", "h", F.coalesce("component", "was").alias("part"))

    # A pair needs ``rest - c size`` of either to be c times the other's size, for c = least / (1 + least). By a part's greatest
    # and least, pairs of parts, and then members and parts, are put aside before members meet members.
    c = least / (1 + least)
    spare = F.col("rest") - c * F.col("size") + 1e-9
    parts = rows.groupBy("h", "part").agg(F.max(spare).alias("spare"), F.min("size").alias("least"))
    side = lambda k: parts.select("h", F.col("part").alias(f"p{k}"), F.col("spare").alias(f"s{k}"), F.col("least").alias(f"l{k}"))
    pairs = side("a").join(side("b"), "h").where((F.col("pa") < F.col("pb")) & (F.col("sa") >= c * F.col("lb")) & (F.col("sb") >= c * F.col("la")))
    members = rows.select("h", "part", "name", "size", "rest", spare.alias("spare"))
    x, y = members.withColumnsRenamed({"part": "pa", "name": "a", "size": "na", "rest": "ra", "spare": "xa"}), members.withColumnsRenamed({"part": "pb", "name": "b", "size": "nb", "rest": "rb", "spare": "xb"})
    pairs = pairs.join(x, ["h", "pa"]).where((F.col("xa") >= c * F.col("lb")) & (F.col("sb") >= c * F.col("na"))).select("h", "pb", "a", "na", "ra", "xa")
    pairs = pairs.join(y, ["h", "pb"]).where((F.col("xa") >= c * F.col("nb")) & (F.col("xb") >= c * F.col("na"))).select("a", "b").distinct()
    out = found.unionByName(_similar(pairs, sets, least))
    for table in (names, prefixes):
        drop_written(table)
    return out


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text: bit b is set if it is set in over half the shingles' XXH64."""
    words = _words(text)
    if not words:
        return 0
    hashes = _shingles(words, shingle, seed)
    n = len(hashes)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)``: the signed 64-bit fingerprint of each row. A null or blank text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _segment(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, BITS * i).bitwiseAND(F.lit(2**BITS - 1))


def has_chain(x: Column, y: Column) -> Column:
    """Whether some start on the ring keeps every cumulative difference within its proportional budget."""
    d = [F.bit_count(_segment(x.bitwiseXOR(y), i)) for i in range(SEGMENTS)]
    found = F.lit(False)
    for i in range(SEGMENTS):
        total, fits = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS + 1):
            total = total + d[(i + length - 1) % SEGMENTS]
            fits = fits & (total <= length * LIMIT // SEGMENTS)
        found = found | fits
    return found


def _slot(c: Column, i: int, j: int) -> Column:
    return F.shiftleft(_segment(c, i), BITS).bitwiseOR(_segment(c, j))


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: enough links between different fingerprints ``fp`` to join all that differ in at most two bits.

    No slot is expanded into all its pairs. Slots of at most ``FULL`` fingerprints are compared in pairs. In a fuller
    slot every fingerprint is filed under itself and the 32 values one bit away in the segments that are not fixed; two
    differ in at most two bits exactly if they share such a value, and those who share one are hung on the smallest.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), _slot(F.col("fp"), i, j).alias("key")) for k, (i, j) in enumerate(PAIRS)]))
    filed = fps.select("fp", slots.alias("s")).select("fp", "s.slot", "s.key")
    sizes = filed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = written(filed.join(sizes, ["slot", "key"]), "slots")

    few = filed.where(F.col("n") <= FULL).groupBy("slot", "key").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, FULL)).alias("b"))
    few = few.where(has_chain(F.col("a"), F.col("b")))

    free = F.create_map(*[x for k, p in enumerate(PAIRS) for x in (F.lit(k), F.array(*[F.lit(BITS * s) for s in range(SEGMENTS) if s not in p]))])
    flips = F.transform(free[F.col("slot")], lambda s: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda o: F.call_function("shiftleft", F.lit(1).cast("long"), s + o)))
    near = F.concat(F.array(F.lit(0).cast("long")), F.flatten(flips))
    many = filed.where(F.col("n") > FULL).select("slot", "fp", F.explode(near).alias("flip"))
    many = many.select("slot", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    hung = many.groupBy("slot", "near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    hung = hung.select("a", F.explode("all").alias("b")).where("a <> b")
    met = few.select("a", "b").unionByName(hung.select("a", "b")).distinct()
    return met.where(has_chain(F.col("a"), F.col("b"))).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``id, fp, component`` (the smallest id that links reach, itself included).

    Two rows link if their fingerprints differ in at most two of 64 bits. Rows of one fingerprint are one class, which
    its smallest id stands for; only different fingerprints are compared. A null or blank text has fingerprint 0 and
    links like any other; repeated rows come back repeated; rows with a null id keep a null id and take no part in
    naming a component; an empty table gives an empty table. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comps = connected_components(links(classes.select("fp")), "a", "b")
    named = classes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("rep").alias("component"))
    return fps.join(named.join(least, "class").select("fp", "component"), "fp", "left").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, null ids last, and then the least text hash.

    Rows link if their fingerprints differ in at most two of 64 bits, or if their five-word shingle sets are similar to
    ``similar``. Rows are judged by their texts, whatever their ids: those without an id, or that share one, are rows
    like others, and of rows that agree in both one stays. Null and blank texts are one class. An empty table stays
    empty; all columns are kept.
    """
    rows = written(banded(docs, id_col, text_col), "bands")
    classes = written(rows.groupBy("name").agg(F.min("fp").alias("rep")), "classes")
    fps = rows.select("fp").distinct()
    # The graph's nodes are fingerprints: texts of one shingle set hang on the least fingerprint that they have.
    near = written(links(fps), "near")
    same = rows.select("name", "fp").distinct().join(classes, "name").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    near = near.unionByName(same)
    a, b = classes.select(F.col("name").alias("a"), F.col("rep").alias("ra")), classes.select(F.col("name").alias("b"), F.col("rep").alias("rb"))
    by_fp = connected_components(near, "a", "b")
    joined = classes.join(by_fp, F.col("rep") == F.col("node"), "left").select("name", F.coalesce("component", "rep").alias("part"))
    heads = joined.groupBy("part").agg(F.min("name").alias("head"))
    known = written(joined.join(heads, "part").where("name <> head").select(F.col("head").alias("a"), F.col("name").alias("b")), "known")
    found = similar_sets(rows, docs, id_col, text_col, similar, known)
    found = found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    comps = connected_components(near.unionByName(found), "a", "b")

    placed = rows.select("id", "hash", "fp").join(comps, F.col("fp") == F.col("node"), "left")
    placed = placed.select(F.struct(F.col("id").isNull().alias("none"), "id", "hash").alias("row"), F.coalesce("component", "fp").alias("component"))
    placed = placed.groupBy("component", "row").agg(F.count("*").alias("n"))
    stays = placed.groupBy("component").agg(F.min("row").alias("first"))
    out = written(placed.join(stays, "component").where("row <> first OR n > 1").select("row.id", "row.hash", (F.col("row") == F.col("first")).alias("again")), "out")
    for table in (rows, classes, near, known):
        drop_written(table)
    out = _sent(out, isinstance(out.schema["id"].dataType, NumericType))
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    same_row = F.expr("_id <=> id AND _hash = hash")
    kept = whole.join(out.select("id", "hash"), same_row, "left_anti")
    again = out.where("again")
    if not again.isEmpty():
        kept = kept.unionByName(whole.join(again, same_row, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
