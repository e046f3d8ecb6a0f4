"""Overlay: the plane cut into faces by all polygons of a layer, each face with those that cover it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, is_lon_lat, layer, need_columns, need_geometry
from geoloom.operators.components import connected_components
from geoloom.operators.order import numbered

TOLERANCE = 1e-9
#: Polygons of a tile.
TILE = 512
_BOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def overlay(
    l: Layer, count_attribute: str = "_overlaps", accumulate: Sequence[str] = (), separator: str = ";", id_attribute: str | None = None, layer_attribute: str | None = None, ambiguous: str = "Drop and report", invalid: str = "Reject"
) -> dict[str, Layer]:
    """``output``: a face a row with how many polygons cover it; ``memberships``; ``rejected``.

    The output has the face, the count, for each accumulated attribute its distinct values in order, and ``face_id`` if
    ids are used. Memberships list (face_id, layer, feature_id). Rows are rejected, for the first reason that holds,
    as no_geometry, no_polygon, missing_id, duplicate_id (within their layer) or invalid_geometry; with
    ``invalid="Repair"`` shapes are repaired instead. Faces too thin to tell who covers them are rejected as
    ambiguous_face, or raise with ``ambiguous="Fail"``.

    The plane is divided into tiles of a bounded number of polygons, which are cut in parallel; faces that a tile's edge
    cuts are joined again, so that a crowded layer is many tasks. Equal shapes are cut as one. Holes that nobody covers are no
    faces.
    """
    if not is_lon_lat(l.crs):
        raise ValueError("the overlay needs a lon/lat layer")
    g = need_geometry(l)
    need_columns(l.df, [*accumulate, *[a for a in (id_attribute, layer_attribute) if a]])
    rows = written(l.df.select(*[col(c) for c in l.columns], F.monotonically_increasing_id().alias("_fid")), "overlay")
    shape = geo.st_shape("make_valid", col(g)) if invalid == "Repair" else col(g)
    name = F.nullif(F.trim(col(id_attribute).cast("string")), F.lit("")) if id_attribute else F.lit(None).cast("string")
    rows = rows.withColumn("_shape", shape).withColumn("_name", name)
    code = F.when(col(g).isNull(), "no_geometry").when(F.size(geo.st_polygons(F.col("_shape"))) == 0, "no_polygon")
    if id_attribute:
        # Names are counted apart, so that neither rows without one nor those of one name gather in a task.
        of = col(layer_attribute) if layer_attribute else F.lit(0)
        twice = rows.where("_name IS NOT NULL").groupBy(of.alias("_of"), F.col("_name").alias("_said")).agg(F.count("*").alias("_times")).where("_times > 1")
        rows = rows.withColumn("_own", of).join(twice, F.expr("_own <=> _of AND _name = _said"), "left").drop("_own", "_of", "_said")
        code = code.when(F.col("_name").isNull(), "missing_id").when(F.col("_times").isNotNull(), "duplicate_id")
    if invalid != "Repair":
        code = code.when(geo.st_measure("is_valid", col(g)) == 0, "invalid_geometry")
    rows = written(rows.withColumn("rejection_code", code), "overlay")
    bad = rows.where("rejection_code IS NOT NULL").select(*[col(c) for c in l.columns], "rejection_code")
    good = rows.where("rejection_code IS NULL")

    parts = good.select("_fid", F.explode(geo.st_polygons(F.col("_shape"))).alias("_part")).withColumn("_b", geo.st_bounds(F.col("_part")))
    parts, stacked = _folded(written(parts, "parts"))
    ends = parts.agg(F.min("_b.minx").alias("a"), F.min("_b.miny").alias("b"), F.max("_b.maxx").alias("c"), F.max("_b.maxy").alias("d")).first()
    tau = max(ends["c"] - ends["a"], ends["d"] - ends["b"], 1.0) * TOLERANCE if ends["a"] is not None else TOLERANCE
    faces = written(_faces(parts, tau), "faces")
    if ambiguous == "Fail" and faces.where("NOT certain").limit(1).count():
        raise ValueError("some faces are too thin to tell who covers them")

    b = geo.st_bounds(F.col("wkb"))
    sure = faces.where("certain").select("wkb", "ids", b.alias("_b"))
    sure = numbered(sure.select("wkb", "ids", "_b.*"), "face_id", ["minx", "miny", "maxx", "maxy", "ids"]).withColumn("face_id", F.col("face_id") - 1)
    sure = written(sure, "faces")
    covers, depth = sure.select("face_id", F.explode("ids").alias("_fid")), F.size("ids").cast("long")
    if stacked is not None:
        one, more = covers.where("_fid >= 0"), covers.join(stacked, F.col("_fid") == F.col("_class")).select("face_id", F.col("_member").alias("_fid"))
        covers = one.unionByName(more).distinct()
        sure = sure.join(covers.groupBy(F.col("face_id").alias("_face")).agg(F.count("*").alias("_depth")), F.col("face_id") == F.col("_face"))
        depth = F.col("_depth")
    members = covers.join(good.drop("_shape"), "_fid")
    face = sure.select("face_id", depth.alias(count_attribute), F.col("wkb").alias(g))
    if accumulate:
        lists = members.groupBy("face_id").agg(*[F.array_join(F.array_sort(F.collect_set(col(a).cast("string"))), separator).alias(a) for a in accumulate])
        face = face.join(lists, "face_id")
    face = face.select(*(["face_id"] if id_attribute else []), count_attribute, *map(col, accumulate), col(g))
    of = col(layer_attribute).cast("string") if layer_attribute else F.lit(None).cast("string")
    listed = members.select("face_id", of.alias("layer"), F.col("_name").alias("feature_id"))
    thin = faces.where("NOT certain").select(F.col("wkb").alias(g), F.lit("ambiguous_face").alias("rejection_code"))
    return {
        "output": layer(face, g, l.crs),
        "memberships": layer(listed if id_attribute else listed.limit(0), crs=l.crs),
        "rejected": layer(bad.unionByName(thin, allowMissingColumns=True), g, l.crs),
    }


def _folded(parts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``parts`` with one row for equal ones, under a number below 0 of their own, and who is meant by it: ``_class, _member``.

    A stack of equal shapes is cut as one, however high it is.
    """
    same = parts.select("_fid", geo.st_shape("normal", F.col("_part")).alias("_same"))
    stacks = same.groupBy("_same").agg(F.count("*").alias("_n")).where("_n > 1")
    stacks = written(stacks.select("_same", (-1 - F.monotonically_increasing_id()).alias("_class"), geo.st_bounds(F.col("_same")).alias("_b")), "stacks")
    if stacks.isEmpty():
        return parts, None
    met = same.join(stacks, "_same")
    members = written(met.select("_class", F.col("_fid").alias("_member")).distinct(), "members")
    alone = parts.withColumn("_same", geo.st_shape("normal", F.col("_part"))).join(stacks.select("_same"), "_same", "left_anti").select("_fid", "_part", "_b")
    return written(alone.unionByName(stacks.select(F.col("_class").alias("_fid"), F.col("_same").alias("_part"), "_b")), "parts"), members


def _faces(parts: DataFrame, tau: float) -> DataFrame:
    """``wkb, certain, ids`` of every face: those of tiles, joined again where a tile's edge cuts them."""
    tiled, box = _tiled(parts, tau)
    by = ["_level", "_x", "_y"]
    groups = tiled.groupBy(*by).agg(F.collect_list(F.struct("_fid", "_part")).alias("_all"))
    faces = groups.select(*by, F.explode(geo.st_faces(F.col("_all"), box, F.lit(tau))).alias("f")).select(*by, "f.*")
    if tiled.select(*by).distinct().limit(2).count() < 2:
        return faces.select("wkb", "certain", "ids")
    faces = written(faces.withColumn("_face", F.monotonically_increasing_id()), "tiles")
    # Stretches meet on one line; which stretch of it, in widths of the largest tile, keeps long lines apart.
    edges = faces.where("certain").select("_face", "ids", F.explode("borders").alias("b")).select("_face", "ids", "b.*")
    widest = faces.agg(F.max(box["maxx"] - box["minx"])).first()[0] or 1.0
    edges = edges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / widest), F.floor(F.col("hi") / widest))))
    low, high = edges.where("NOT above").alias("p"), edges.where("above").alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("axis", "at", "_bin", "ids")]
    meet = F.least("p.hi", "q.hi") - F.greatest("p.lo", "q.lo") > tau
    pairs = low.join(high, [*same, meet]).select(F.col("p._face").alias("a"), F.col("q._face").alias("b"))
    comps = connected_components(pairs, "a", "b")
    named = faces.join(comps, F.col("_face") == F.col("node"), "left").withColumn("_whole", F.coalesce("component", "_face"))
    return named.groupBy("_whole").agg(F.when(F.count(F.lit(1)) == 1, F.first("wkb")).otherwise(geo.st_union(F.collect_list("wkb"))).alias("wkb"), F.first("certain").alias("certain"), F.first("ids").alias("ids")).drop("_whole")


def _tiled(parts: DataFrame, tau: float) -> tuple[DataFrame, Column]:
    """``_level, _x, _y, _fid, _part``: parts cut by tiles of at most about ``TILE`` of them, and a tile's box.

    A tile that holds more is divided, and what it holds is cut again, until dividing doesn't help. Tiles of all levels
    have their edges on the same lines, which are laid so that coordinates of round numbers aren't on them.
    """
    start = parts.select(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_x"), F.lit(0).cast("long").alias("_y"), F.lit(2**62).alias("_up"), "_fid", "_part", "_b")
    ends = parts.agg(F.count(F.lit(1)).alias("n"), F.min("_b.minx").alias("a"), F.min("_b.miny").alias("b"), F.max("_b.maxx").alias("c"), F.max("_b.maxy").alias("d")).first()
    if ends["n"] <= TILE:
        return start, F.lit(None).cast(_BOX)
    side = max(ends["c"] - ends["a"], ends["d"] - ends["b"], 1000 * tau) * 1.2718281828
    ox, oy = ends["a"] - side * 0.0314159265, ends["b"] - side * 0.0577215664
    deepest = max(0, int(math.log2(side / (1000 * tau))))

    def box(level: Column, x: Column, y: Column) -> Column:
        share = lambda k: k.cast("double") / F.pow(F.lit(2.0), level)
        lines = {"minx": F.lit(ox) + F.lit(side) * share(x), "miny": F.lit(oy) + F.lit(side) * share(y), "maxx": F.lit(ox) + F.lit(side) * share(x + 1), "maxy": F.lit(oy) + F.lit(side) * share(y + 1)}
        return F.struct(*[c.alias(n) for n, c in lines.items()])

    by, out, todo = ["_level", "_x", "_y"], [], start
    while True:
        sizes = todo.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_up").alias("_before"))
        over = written(sizes.where((F.col("_n") > TILE) & (F.col("_n") < 0.9 * F.col("_before")) & (F.col("_level") < deepest)).select(*by, "_n"), "overfull")
        kept = ["_level", "_x", "_y", "_fid", "_part"]
        out.append(todo.join(over, by, "left_anti").select(*kept))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, out), box(F.col("_level"), F.col("_x"), F.col("_y"))
        more = F.least(F.greatest(F.ceil(F.log2(F.col("_n") / TILE) / 2), F.lit(1)), F.lit(3), F.lit(deepest) - F.col("_level")).cast("int")
        cut = todo.join(over, by).withColumn("_more", more).withColumn("_wide", F.pow(F.lit(2.0), F.col("_more")).cast("long"))
        place = lambda lo, o: F.floor((F.col(f"_b.{lo}") - o) / side * F.pow(F.lit(2.0), F.col("_level") + F.col("_more")))
        span = lambda lo, hi, o, at: F.sequence(F.greatest(place(lo, o), F.col(at) * F.col("_wide")), F.greatest(F.least(place(hi, o), F.col(at) * F.col("_wide") + F.col("_wide") - 1), F.greatest(place(lo, o), F.col(at) * F.col("_wide"))))
        cut = cut.withColumn("_cx", F.explode(span("minx", "maxx", ox, "_x"))).withColumn("_cy", F.explode(span("miny", "maxy", oy, "_y")))
        cut = cut.select((F.col("_level") + F.col("_more")).alias("_level"), F.col("_cx").alias("_x"), F.col("_cy").alias("_y"), F.col("_n").alias("_up"), "_fid", "_part")
        cut = cut.withColumn("_part", F.explode(geo.st_clip(F.col("_part"), box(F.col("_level"), F.col("_x"), F.col("_y")))))
        todo = written(cut.withColumn("_b", geo.st_bounds(F.col("_part"))), "tiles")
