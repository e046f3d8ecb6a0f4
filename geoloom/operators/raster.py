"""Values of rasters at places, and areas of equal value, over a table of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import LON_LAT, Layer, layer, need_geometry
from geoloom.operators.combine import spatial_join
from geoloom.operators.components import connected_components
from geoloom.sources.rasters import Rasters


def sample_raster(l: Layer, tiles: DataFrame | Rasters, band: int = 1, attribute: str = "raster_value", crs: str = LON_LAT) -> Layer:
    """Append the value of a band at each feature (lines and areas at a point on them), null outside and for nodata.

    Features find their pixel by the raster's inverse transform, and its tile by an equal block: no raster is held
    whole. Where rasters overlap, the first by name that has a value gives it. Of files (``open_rasters``) only those blocks
    are read in which features lie: places are put in the order of their blocks, however many lie in one, and each task
    reads its own.
    """
    if attribute in l.columns:
        raise ValueError(f"the attribute {attribute} exists already")
    if l.crs != crs:
        raise ValueError("layer and raster have different coordinate reference systems")
    g = col(need_geometry(l))
    rows = written(l.df.select("*", F.monotonically_increasing_id().alias("_id")), "sampled")
    points = rows.select("_id", geo.st_shape("point_on_surface", g).alias("_p")).where("_p IS NOT NULL")
    t, files = F.col("transform"), isinstance(tiles, Rasters)
    if files:
        grids = written(tiles.heads.where(F.col("bands") >= band).select("raster", "bw", "bh", "transform", F.col("width").alias("_w"), F.col("height").alias("_h")), "rasters")
    else:
        own = tiles.where(F.col("band") == band)
        grids = own.groupBy("raster", "bw", "bh", "transform").agg(F.max(F.col("x0") + F.col("w")).alias("_w"), F.max(F.col("y0") + F.col("h")).alias("_h"))
    place = lambda i, j: (t[0] * i + t[1] * j + t[2], t[3] * i + t[4] * j + t[5])
    corners = [place(i, j) for i in (F.lit(0), F.col("_w")) for j in (F.lit(0), F.col("_h"))]
    xs, ys = zip(*corners, strict=True)
    grids = grids.select("raster", "bw", "bh", "transform", "_w", "_h", geo.st_box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).alias("_f"))
    # Features meet only the rasters whose outlines hold them.
    near = spatial_join(layer(points, "_p", crs), layer(grids, "_f", crs)).df
    near = near.withColumn("_x", geo.st_x(F.col("_p"))).withColumn("_y", geo.st_y(F.col("_p")))
    d = t[0] * t[4] - t[1] * t[3]
    x, y = F.col("_x") - t[2], F.col("_y") - t[5]
    placed = near.withColumn("_c", F.floor((t[4] * x - t[1] * y) / d)).withColumn("_r", F.floor((t[0] * y - t[3] * x) / d))
    if files:
        inside = F.col("_c").between(0, F.col("_w") - 1) & F.col("_r").between(0, F.col("_h") - 1)
        block = ["raster", F.floor(F.col("_r") / F.col("bh")), F.floor(F.col("_c") / F.col("bw"))]
        placed = placed.where(inside).select("_id", "raster", "_c", "_r", block[1].alias("_by"), block[2].alias("_bx"))
        order = ["raster", "_by", "_bx", "_id"]
        # Written, as the optimiser drops an order that an aggregate doesn't need, and moves a filter on the value ahead of it:
        # blocks would be read in any order, again and again.
        found = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "raster", geo.tiff_value(F.col("raster"), F.lit(band), F.col("_c"), F.col("_r")).alias("_v"))
        values = written(found, "values").where("_v IS NOT NULL").groupBy("_id").agg(F.min_by("_v", "raster").alias(attribute))
        return l.with_df(rows.join(values, "_id", "left").select(*[col(c) for c in l.columns], attribute))
    placed = placed.select("_id", "raster", "_c", "_r", F.floor(F.col("_c") / F.col("bw")).cast("int").alias("bx"), F.floor(F.col("_r") / F.col("bh")).cast("int").alias("by"))
    hit = placed.join(own, ["raster", "bx", "by"])
    inside = F.col("_c").between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.col("_r").between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    k = ((F.col("_r") - F.col("y0")) * F.col("w") + F.col("_c") - F.col("x0")).cast("int")
    values = hit.where(inside).select("_id", "raster", F.get("pixels", k).alias("_v")).where("_v IS NOT NULL").groupBy("_id").agg(F.min_by("_v", "raster").alias(attribute))
    return l.with_df(rows.join(values, "_id", "left").select(*[col(c) for c in l.columns], attribute))


def raster_to_polygons(tiles: DataFrame, band: int = 1, crs: str = LON_LAT) -> Layer:
    """``raster, value, geometry``: an area for each patch of equal values that share sides; nodata is none.

    Each tile's patches are found where the tile is; patches that touch across tiles are joined as components, and
    their pieces united.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                grid = np.array([np.nan if v is None else v for v in r["pixels"]], float).reshape(r["h"], r["w"])
                yield from _runs(grid, r)

    own = tiles.where(F.col("band") == band).select("raster", "x0", "y0", "w", "h", "transform", "pixels")
    runs = own.mapInArrow(label, "raster string, patch string, value double, y int, xa int, xb int, edge boolean, transform array<double>")
    runs = written(runs, "runs")
    ids = runs.select("raster", "patch").distinct().select("raster", "patch", F.monotonically_increasing_id().alias("id"))
    ids = written(ids, "patches")
    # Pixels at the sides of tiles meet their neighbours to the right and below.
    edge = runs.where("edge").select("raster", "patch", "value", "y", F.explode(F.sequence("xa", "xb")).alias("x")).join(ids, ["raster", "patch"])
    near = F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))).alias("n")
    ahead = edge.select("raster", "value", "id", near).select("raster", "value", F.col("id").alias("other"), "n.x", "n.y")
    links = edge.join(ahead, ["raster", "value", "x", "y"]).where("id <> other").select("id", "other").distinct()
    comps = connected_components(links, "id", "other")
    named = ids.join(comps, F.col("id") == F.col("node"), "left").select("raster", "patch", F.coalesce("component", "id").alias("_c"))
    t = F.col("transform")
    place = lambda i, j: (t[0] * i + t[1] * j + t[2], t[3] * i + t[4] * j + t[5])
    (ax, ay), (bx, by) = place(F.col("xa"), F.col("y")), place(F.col("xb") + 1, F.col("y") + 1)
    box = geo.st_box(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))
    pieces = runs.select("raster", "patch", "value", box.alias("_g")).groupBy("raster", "patch").agg(F.first("value").alias("value"), geo.st_union(F.collect_list("_g")).alias("_g"))
    whole = pieces.join(named, ["raster", "patch"]).groupBy("raster", "_c").agg(F.first("value").alias("value"), geo.st_union(F.collect_list("_g")).alias("geometry"))
    return layer(whole.select("raster", "value", "geometry"), "geometry", crs)


def _runs(grid: np.ndarray, r: dict) -> Iterator[pa.RecordBatch]:
    """The runs of equal values in each row of a tile, named by the patch of the tile to which they belong."""
    h, w = grid.shape
    parent: list[int] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    runs, above = [], []
    for y in range(h):
        row, here = grid[y], []
        cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), w]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and not np.isnan(row[a]):
                k = len(parent)
                parent.append(k)
                for xa, xb, v, j in above:
                    if v == row[a] and xa < b and a < xb:
                        parent[find(k)] = find(j)
                here.append((a, b, row[a], k))
        runs += [(y, *x) for x in here]
        above = here
    if not runs:
        return
    name = f"{r['x0']}:{r['y0']}"
    out = {"raster": [], "patch": [], "value": [], "y": [], "xa": [], "xb": [], "edge": [], "transform": []}
    for y, a, b, v, k in runs:
        out["raster"].append(r["raster"])
        out["patch"].append(f"{name}:{find(k)}")
        out["value"].append(float(v))
        out["y"].append(y + r["y0"])
        out["xa"].append(a + r["x0"])
        out["xb"].append(b - 1 + r["x0"])
        out["edge"].append(y in (0, h - 1) or a == 0 or b == w)
        out["transform"].append(r["transform"])
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("raster", pa.string()), ("patch", pa.string()), ("value", pa.float64()), ("y", pa.int32()), ("xa", pa.int32()), ("xb", pa.int32()), ("edge", pa.bool_()), ("transform", pa.list_(pa.float64()))]))
