"""One large GeoJSON collection, parsed by many tasks.

Spark's text reader cuts the document after closing braces, wherever these are, into splits that tasks read. What a split's
text means depends on what came before: whether it starts inside a string, how deep it is nested, whether it is in the array
of features. A first pass finds for either answer to the first question how a split ends; these are composed along the
document, one short row for each split. With each split's start known, the next passes find its features and cut them out;
only those that cross the end of a split are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUT = b"}"
#: Bytes outside the arrays of features that may come to the driver.
MOST_BESIDE = 16 << 20
_ARRAY = re.compile(rb'"features"\s*:\s*\Z')
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[ord("{"), ord("[")]] = 1
_CLOSE[[ord("}"), ord("]")]] = 1


def splits(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: the pieces of each split in order, without the brace that ends each."""
    return spark.read.text(path, lineSep=CUT.decode()).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Runs of pieces of one split, each with its brace; a split may come in several runs, one after the other."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        values, first = b.column(2).to_pylist(), 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                yield keys[first], b"".join(v + CUT for v in values[first:k])
                first = k


def quotes(text: np.ndarray) -> np.ndarray:
    """Which characters begin or end a string: quotes that aren't escaped by an odd number of backslashes."""
    marks = text == ord('"')
    slashes = np.flatnonzero(text == ord("\\"))
    if len(slashes):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(slashes) > 1]))
        ends = np.concatenate([slashes[heads[1:] - 1], slashes[-1:]]) + 1
        odd = (ends - slashes[heads]) % 2 == 1
        after = ends[odd]
        marks[after[after < len(text)]] = False
    return marks


def _outside(text: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Which characters are outside strings, and whether the end is inside one."""
    turns = np.cumsum(quotes(text), dtype=np.int64) + inside
    return turns % 2 == 0, int(turns[-1] % 2) if len(turns) else inside


def depths(text: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The change of nesting at each character, the nesting after it, and whether the end is inside a string."""
    outside, end = _outside(text, inside)
    change = (_OPEN[text] - _CLOSE[text]) * outside
    return change, np.cumsum(change, dtype=np.int64) + depth, end


@dataclass
class Place:
    """Where a scan is: in a string, how deep, in the array of features, and whether that has been seen."""

    inside: int = 0
    depth: int = 0
    listed: bool = False


def found(text: bytes, at: Place) -> tuple[list[tuple[int, int | None]], int | None, list[tuple[int, int]]]:
    """The features in a text, ``(first, after the last)`` each, None if it isn't ended; where one that had begun before ends
    (-1: nowhere here); what is outside the array of features. ``at`` moves on to the end of the text."""
    chars = np.frombuffer(text, np.uint8)
    change, depth, inside = depths(chars, at.inside, at.depth)
    running = at.listed and at.depth > 2
    events = np.flatnonzero((change != 0) & ((depth <= 2) | ((change == 1) & (depth == 3))))
    features, first, rest, outer, ends = [], None, [], 0 if not at.listed else None, None
    for k in events.tolist():
        if change[k] == 1 and depth[k] == 2 and not at.listed and text[k : k + 1] == b"[" and _ARRAY.search(text, max(0, k - 200), k):
            at.listed = True
            rest.append((outer, k + 1))
            outer = None
        elif at.listed and change[k] == 1 and depth[k] == 3:
            first = k
        elif at.listed and change[k] == -1 and depth[k] == 2:
            if first is None:
                ends = k + 1
            else:
                features.append((first, k + 1))
                first = None
        elif at.listed and change[k] == -1 and depth[k] == 1:
            at.listed, outer = False, k
    if first is not None:
        features.append((first, None))
    if outer is not None:
        rest.append((outer, len(text)))
    at.inside, at.depth = inside, int(depth[-1]) if len(depth) else at.depth
    return features, (ends if ends is not None else -1) if running else None, rest


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether its quotes are odd in number, and by how much it nests if it starts outside or inside a string."""
    held: dict[tuple[str, int], list[int]] = {}
    for key, text in _texts(batches):
        chars = np.frombuffer(text, np.uint8)
        odd, deeper = held.get(key, [0, 0, 0])[0], held.setdefault(key, [0, 0, 0])
        outside, end = _outside(chars, odd)
        change = (_OPEN[chars] - _CLOSE[chars]).astype(np.int64)
        deeper[0] = end
        deeper[1] += int(change[outside].sum())
        deeper[2] += int(change[~outside].sum())
    rows = [[f, s, *v] for (f, s), v in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["file", "start", "odd", "out", "in"])


def _lists(batches: Iterator[pa.RecordBatch], places: dict) -> Iterator[pa.RecordBatch]:
    """For each split: whether its end is in an array of features that it opens (1), in none (-1), or as its start (0); and how low it nests."""
    held: dict[tuple[str, int], tuple[Place, list[int]]] = {}
    for key, text in _texts(batches):
        at, seen = held.setdefault(key, (Place(*places[key], False), [0, places[key][1]]))
        before = at.listed
        low = int(depths(np.frombuffer(text, np.uint8), at.inside, at.depth)[1].min(initial=at.depth))
        found(text, at)
        if low <= 1 or at.listed != before:
            seen[0] = 1 if at.listed else -1
        seen[1] = min(seen[1], low)
    rows = [(f, s, *v[1]) for (f, s), v in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))], ["file", "start", "last", "low"])


def _cut(batches: Iterator[pa.RecordBatch], places: dict) -> Iterator[pa.RecordBatch]:
    """Features that lie in a split as rows of their own (part -1), what is outside their array (-2), and the parts of others:
    the number of a part is that of the split where its feature begins."""
    key, at, carried, begun, n = None, Place(), None, None, 0

    def rows(out: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        nonlocal n
        if out:
            k, n = len(out), n + len(out)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * k), pa.array([key[1]] * k, pa.int64()), pa.array(range(n - k, n), pa.int64()), pa.array([o for o, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["file", "start", "n", "part", "text"])

    for own, text in _texts(batches):
        if own != key:
            if begun:  # still open where its split ends
                yield from rows([(key[1], b"".join(begun))])
            key, at, carried, begun, n = own, Place(*places[own][:3]), places[own][3], None, 0
        features, ended, rest = found(text, at)
        out = [(-2, text[a:b]) for a, b in rest]
        if ended is not None:
            piece = text if ended < 0 else text[:ended]
            if carried is not None:
                out.append((carried, piece))
            else:
                begun.append(piece)
            if ended >= 0:
                out += [(-1, b"".join(begun))] if carried is None else []
                carried = begun = None
        for a, b in features:
            if b is None:
                begun = [text[a:]]
            else:
                out.append((-1, text[a:b]))
        yield from rows(out)
    if begun:
        yield from rows([(key[1], b"".join(begun))])


def feature_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``value``: each feature of the collections below a path as text in one line, and what else the documents hold.

    Two passes read the text without keeping any of it; the third cuts it up when the result is read. A feature that is cut by
    the end of a split is put together from its parts, however many splits it spans. One row for each split, and what stands
    outside the arrays of features, come to the driver.
    """
    pieces = splits(spark, path)
    rows = sorted(pieces.mapInArrow(_ends, "file string, start long, odd int, `out` long, `in` long").collect())
    starts: dict[tuple[str, int], tuple[int, int]] = {}
    name, inside, depth = None, 0, 0
    for f, start, odd, out, within in rows:
        if f != name:
            name, inside, depth = f, 0, 0
        starts[f, start] = (inside, depth)
        inside, depth = inside ^ odd, depth + (within if inside else out)
    seen = {(r["file"], r["start"]): (r["last"], r["low"]) for r in pieces.mapInArrow(lambda it: _lists(it, starts), "file string, start long, last int, low long").collect()}
    places: dict[tuple[str, int], tuple[int, int, bool, int | None]] = {}
    name, listed, open_in = None, False, None
    keys = [(f, s) for f, s, *_ in rows]
    for k, key in enumerate(keys):
        if key[0] != name:
            name, listed, open_in = key[0], False, None
        inside, depth = starts[key]
        goes_on = listed and depth > 2
        places[key] = (inside, depth, listed, open_in if goes_on else None)
        after = starts[keys[k + 1]] if k + 1 < len(keys) and keys[k + 1][0] == name else (0, 0)
        last, low = seen[key]
        listed = last == 1 or (last == 0 and listed)
        # A feature that is open at the end began here, unless the one from before is still open.
        if listed and after[1] > 2 and not (goes_on and low > 2):
            open_in = key[1]
    cut = pieces.mapInArrow(lambda it: _cut(it, places), "file string, start long, n long, part long, text binary")
    whole = cut.where("part = -1").select("text")
    joined = cut.where("part >= 0").groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("parts"))
    joined = joined.select(F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["text"])).alias("text"))
    lines = whole.unionByName(joined).select(F.regexp_replace(F.decode("text", "UTF-8"), r"[\r\n]+", " ").alias("value"))
    if (cut.where("part = -2").agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_BESIDE:
        raise ValueError(f"{path} holds too much beside its features, or isn't GeoJSON")
    rest: dict[str, list] = {}
    for r in cut.where("part = -2").select("file", "start", "n", "text").collect():
        rest.setdefault(r["file"], []).append((r["start"], r["n"], bytes(r["text"])))
    return lines, [b"".join(t for *_, t in sorted(parts)).decode("utf-8", "replace") for _, parts in sorted(rest.items())]
