"""Joins and unions of layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, layer, need_columns, need_geometry, same_crs

#: Pairs that a task makes of classes of equal shapes, and how many tasks at most.
PAIRS, TASKS = 250_000, 4000
JOINS = {"Inner": "inner", "Left": "left", "Full": "full"}


def feature_join(left: Layer, right: Layer, keys: Sequence[tuple[str, str]], join_type: str = "Inner", suffix: str = "_right") -> dict[str, Layer]:
    """``joined``, ``unjoinedLeft`` and ``unjoinedRight`` by equal keys; nulls equal nothing.

    Left columns come first; the right keys go, so that in a full join a row of the right alone has null keys; other
    right columns whose names clash get the suffix.
    """
    pairs = [(a, b) for a, b in keys if a and b]
    if not pairs:
        raise ValueError("at least one pair of keys is needed")
    need_columns(left.df, [a for a, _ in pairs])
    need_columns(right.df, [b for _, b in pairs])
    crs = same_crs(left, right) if left.geometry and right.geometry else (left if left.geometry else right).crs
    l, r = left.df.alias("l"), right.df.alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in pairs])
    gone, taken, named = {b for _, b in pairs}, set(left.columns), []
    for c in right.columns:
        if c in gone:
            continue
        name = c
        while name in taken:
            name += suffix or "_right"
        taken.add(name)
        named.append(F.col(f"r.`{c}`").alias(name))
    joined = l.join(r, on, JOINS[join_type]).select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *named)
    return {
        "joined": layer(joined, left.geometry or right.geometry, crs),
        "unjoinedLeft": left.with_df(l.join(r, on, "left_anti")),
        "unjoinedRight": right.with_df(r.join(l, on, "left_anti")),
    }


def union_by_name(top: Layer, bottom: Layer) -> Layer:
    """All rows of both, columns matched by name; a missing column is null; duplicates stay."""
    crs = same_crs(top, bottom)
    df = top.df.unionByName(bottom.df, allowMissingColumns=True)
    return layer(df, top.geometry or bottom.geometry, crs)


def spatial_join(left: Layer, right: Layer, predicate: str = "intersects", distance: float | None = None, how: str = "inner", cell: float | None = None, suffix: str = "_right", measures: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> Layer:
    """Rows of both whose geometries intersect, or are within ``distance`` (``predicate="dwithin"``).

    Squares have sides of powers of four. Each envelope is at home on the level of its own size, where it touches four squares
    at most, and visits the coarser levels on which rows of the other side are at home: so a pair meets on the level of the
    larger one, however different they are, and no envelope is cut into many squares. Of the squares of that level in which a
    pair meets it counts in the one that holds the lower left corner of their envelopes' overlap. A square that is crowded on
    one side is split there, and copied on the other, as adaptive execution sees fit. ``cell`` is a least side. Left rows
    without a partner stay with ``how="left"``; null and empty geometries meet nothing.

    On a side that is half copies or more, equal shapes meet others as one, and their rows come in afterwards, dealt by the
    number of pairs. ``measures`` adds last columns, each made of both shapes, which are worked out once for equal pairs.
    """
    crs = same_crs(left, right)
    if predicate not in ("intersects", "dwithin") or how not in ("inner", "left"):
        raise ValueError("predicate is intersects or dwithin, how is inner or left")
    reach = float(distance or 0) if predicate == "dwithin" else 0.0
    lg, rg = need_geometry(left), need_geometry(right)
    l = left.df.select("*", F.monotonically_increasing_id().alias("_left"), geo.st_bounds(col(lg)).alias("_b"))
    r = right.df.select("*", F.monotonically_increasing_id().alias("_right"), geo.st_bounds(col(rg)).alias("_b"))
    l, r = l.withColumn("_l", _level(reach)), r.withColumn("_l", _level(0.0))
    # Both are read several times; the rows' numbers and shapes must not change, nor be worked out again.
    l, r = written(l, "left"), written(r, "right")
    levels = [{x["_l"] for x in side.where("_b IS NOT NULL").select("_l").distinct().collect()} for side in (l, r)]
    least = min([k for own in levels for k in own if k is not None], default=0)
    least = max(least, math.ceil(math.log(cell, 4))) if cell else least
    at_home = [sorted({max(least if k is None else k, least) for k in own}) for own in levels]
    names = {c: c for c in right.columns}
    for c in right.columns:
        while names[c] in left.columns:
            names[c] += suffix
    a, b = F.col(f"l.`{lg}`"), F.col(f"r.`{rg}`")
    meets = geo.st_intersects(a, b) if predicate == "intersects" else geo.st_distance(a, b) <= reach
    near = (F.col("l._b.minx") - reach <= F.col("r._b.maxx")) & (F.col("l._b.maxx") + reach >= F.col("r._b.minx")) & (F.col("l._b.miny") - reach <= F.col("r._b.maxy")) & (F.col("l._b.maxy") + reach >= F.col("r._b.miny"))
    side = F.pow(F.lit(4.0), F.col("l._at"))
    corner = lambda lo: F.floor(F.greatest(F.col(f"l._b.{lo}") - reach, F.col(f"r._b.{lo}")) / side)
    once = (corner("minx") == F.col("l._cx")) & (corner("miny") == F.col("l._cy"))
    square = (F.col("l._at") == F.col("r._at")) & (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy"))
    ls, lrows = _shapes(l, lg, "_left")
    rs, rrows = _shapes(r, rg, "_right")
    # Columns by number, so that names of both sides don't meet; those of a folded side come with its rows.
    lcols, rcols = {c: f"_l{k}" for k, c in enumerate(["_left", *left.columns])}, {c: f"_r{k}" for k, c in enumerate(["_right", *right.columns])}
    own = lambda side, cols, folded: [F.col(f"{side}.{n}").alias(f"_{side}{n}") for n in ("_class", "_n")] if folded else [F.col(f"{side}.`{c}`").alias(n) for c, n in cols.items()]
    keep = [*own("l", lcols, lrows is not None), *own("r", rcols, rrows is not None), *[f(a, b).alias(f"_m{k}") for k, f in enumerate((measures or {}).values())]]

    def met(lefts: DataFrame, rights: DataFrame) -> DataFrame:
        return lefts.alias("l").join(rights.alias("r"), square).where(once & near).where(meets).select(*keep)

    # Those at home on the right meet all on the left; those that only visit meet those at home on the left.
    found = met(_filed(ls, reach, least, at_home[1], home=True), _filed(rs, 0.0, least, [], home=True))
    if any(y > x for y in at_home[0] for x in at_home[1]):
        found = found.unionByName(met(_filed(ls, reach, least, [], home=True), _filed(rs, 0.0, least, at_home[0], home=False)))
    if lrows is not None or rrows is not None:
        found = written(found, "pairs")
    if lrows is not None:
        members = lrows.select("_class", *[col(c).alias(n) for c, n in lcols.items()])
        # With classes on both sides these are no more rows than shapes that a row meets.
        found = _with_rows(found, "_l", members, F.col(rcols["_right"])) if rrows is None else found.join(members, F.col("_l_class") == F.col("_class")).drop("_l_class", "_l_n", "_class")
    if rrows is not None:
        found = _with_rows(found, "_r", rrows.select("_class", *[col(c).alias(n) for c, n in rcols.items()]), F.col(lcols["_left"]))
    added = [F.col(f"_m{k}").alias(n) for k, n in enumerate(measures or {})]
    partner = [F.col(rcols[c]).alias(n) for c, n in names.items()]
    if how == "inner":
        return layer(found.select(*[F.col(lcols[c]).alias(c) for c in left.columns], *partner, *added), lg, crs)
    found = found.select(F.col(lcols["_left"]).alias("_left"), F.struct(*partner, *added).alias("_r") if partner or added else F.lit(0).alias("_r"))
    out = l.join(found, "_left", "left")
    return layer(out.select(*map(col, left.columns), *[F.col(f"_r.`{n}`").alias(n) for n in (*names.values(), *(measures or {}))]), lg, crs)


def _shapes(df: DataFrame, g: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows as they are; or, if half are copies or more, the different shapes, ``_class`` and how many rows ``_n``, and the rows with theirs."""
    rows, different = df.where("_b IS NOT NULL").agg(F.count(F.lit(1)), F.approx_count_distinct(col(g))).first()
    if rows < 2 * different:
        return df, None
    shapes = df.where("_b IS NOT NULL").groupBy(col(g)).agg(F.count(F.lit(1)).alias("_n"), F.first("_b").alias("_b"), F.first("_l").alias("_l"))
    shapes = written(shapes.withColumn("_class", F.monotonically_increasing_id()), "shapes")
    of = shapes.select("_class", col(g).alias("_same"))
    return shapes, written(df.drop("_b", "_l").join(of, col(g) == F.col("_same")).drop("_same"), "members")


def _with_rows(pairs: DataFrame, side: str, rows: DataFrame, other: Column) -> DataFrame:
    """``pairs`` with a row for each of the ``rows`` of their class on a side.

    What comes of a class is dealt to tasks by its size: by the ``other`` side's rows, in shares to each of which the
    class's rows go.
    """
    own, n = F.col(f"{side}_class"), F.col(f"{side}_n")
    made = pairs.groupBy(own.alias("_class")).agg(F.count(F.lit(1)).alias("_m"), F.sum(n).alias("_made"))
    made = written(made, "made")
    total = made.agg(F.sum("_made")).first()[0] or 0
    tasks = max(1, min(TASKS, math.ceil(total / PAIRS)))
    shares = F.least(F.ceil(F.col("_made") / PAIRS), F.ceil(F.col("_m") / 1000)).cast("int")
    crowded = made.withColumn("_shares", shares).where("_shares > 1").select(F.col("_class").alias("_crowd"), "_shares")
    share = F.coalesce("_shares", F.lit(1))
    left = pairs.join(crowded, own == F.col("_crowd"), "left").withColumn("_share", F.pmod(F.xxhash64(other), share).cast("int"))
    right = rows.join(crowded, F.col("_class") == F.col("_crowd"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), share - 1)))
    left, right = left.drop("_crowd", "_shares").repartition(tasks, own, F.col("_share")), right.drop("_crowd", "_shares").repartition(tasks, F.col("_class"), F.col("_part"))
    return left.join(right, (own == F.col("_class")) & (F.col("_share") == F.col("_part"))).drop(f"{side}_class", f"{side}_n", "_class", "_share", "_part")


def _level(reach: float):
    """The power of four that an envelope, widened by ``reach``, fits in; null for a point, which fits anywhere."""
    size = F.greatest(F.col("_b.maxx") - F.col("_b.minx"), F.col("_b.maxy") - F.col("_b.miny")) + 2 * reach
    return F.when(size > 0, F.ceil(F.log(4.0, size))).cast("int")


def _filed(df: DataFrame, reach: float, least: int, others: list[int], home: bool) -> DataFrame:
    """A row for each square that the envelope, widened by ``reach``, touches at home, if wanted, and on coarser levels of ``others``."""
    own = F.greatest(F.coalesce(F.col("_l"), F.lit(least)), F.lit(least))
    above = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_own"))
    df = df.where("_b IS NOT NULL").withColumn("_own", own).withColumn("_at", F.explode(F.concat(F.array("_own"), above) if home else above))
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"_b.{lo}") - reach) / F.pow(F.lit(4.0), F.col("_at"))), F.floor((F.col(f"_b.{hi}") + reach) / F.pow(F.lit(4.0), F.col("_at"))))
    return df.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy")))
