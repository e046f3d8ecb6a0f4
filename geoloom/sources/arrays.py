"""Zarr arrays as rows: chunks are read as files, in parallel, and decoded where they are read."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.cluster import get_text, matches
from geoloom.functions import geo
from geoloom.layer import LON_LAT, Layer, known_crs, layer

#: Names by which the two spatial axes are found, and attributes that carry the reference system, in the
#: order in which they are believed, or that name what is no measurement.
Y_NAMES = ("y", "lat", "latitude", "northing", "row")
X_NAMES = ("x", "lon", "long", "longitude", "easting", "col", "column")
CRS_NAMES = ("crs_wkt", "spatial_ref", "crs", "proj:wkt2", "esri_pe_string", "epsg")
NODATA_NAMES = ("_FillValue", "missing_value", "nodata", "nodatavals", "fill_value")
#: A window that touches more rows or columns of chunks than this is looked for by pattern, and then by number.
SPELLED = 500


@dataclass(frozen=True)
class ArrayMeta:
    """What the metadata of a version 2 or 3 array says."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    dims: tuple[str, ...]
    codec: str | None
    separator: str
    prefix: str
    fill: float | None
    order: str
    attrs: dict

    @property
    def axes(self) -> tuple[int, int]:
        """The places of y and x: by name, else the last two."""
        low = [d.lower() for d in self.dims]
        y, x = next((low.index(n) for n in Y_NAMES if n in low), None), next((low.index(n) for n in X_NAMES if n in low), None)
        n = len(self.shape)
        return (n - 2, n - 1) if y is None or x is None else (y, x)


_CELLS = "y_index long, x_index long, x double, y double, value double"


def _text(spark: SparkSession, path: str) -> dict | None:
    text = get_text(spark, path)
    return None if text is None else json.loads(text)


def array_meta(spark: SparkSession, path: str) -> ArrayMeta:
    if v3 := _text(spark, f"{path}/zarr.json"):
        codecs = [c["name"] for c in v3.get("codecs", [])]
        coder = next((c for c in codecs if c in ("zstd", "gzip", "zlib")), None)
        if bad := set(codecs) - {"bytes", "zstd", "gzip", "zlib"}:
            raise ValueError(f"unknown Zarr codecs: {bad}")
        key = v3.get("chunk_key_encoding", {})
        sep = key.get("configuration", {}).get("separator", "/")
        dims = v3.get("dimension_names") or [f"dim_{k}" for k in range(len(v3["shape"]))]
        kind = np.dtype(v3["data_type"]).newbyteorder("<").str
        return ArrayMeta(tuple(v3["shape"]), tuple(v3["chunk_grid"]["configuration"]["chunk_shape"]), kind, tuple(dims), coder, sep, "c" + sep if key.get("name", "default") == "default" else "", v3.get("fill_value"), "C", v3.get("attributes", {}))
    v2 = _text(spark, f"{path}/.zarray")
    if v2 is None:
        raise ValueError(f"{path} is no Zarr array")
    coder = (v2.get("compressor") or {}).get("id")
    if coder not in (None, "zstd", "zlib", "gzip") or v2.get("filters"):
        raise ValueError(f"unknown Zarr codec: {coder}")
    attrs = _text(spark, f"{path}/.zattrs") or {}
    dims = attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{k}" for k in range(len(v2["shape"]))]
    return ArrayMeta(tuple(v2["shape"]), tuple(v2["chunks"]), v2["dtype"], tuple(dims), coder, v2.get("dimension_separator", "."), "", v2.get("fill_value"), v2.get("order", "C"), attrs)


def unpacked(raw: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zlib.decompress(raw, 47) if codec else raw


def zarr_plan(meta: ArrayMeta, pins: dict[str, int] | None = None, window: tuple[int, int, int, int] | None = None, step: int = 1) -> dict:
    """Rows, chunks and bytes that a read would make; the window is (first row, first column, rows, columns)."""
    y, x = meta.axes
    r0, c0, rows, cols = window or (0, 0, meta.shape[y], meta.shape[x])
    rows, cols = min(rows, meta.shape[y] - r0), min(cols, meta.shape[x] - c0)
    across = lambda first, n, size: (first + n - 1) // size - first // size + 1 if n > 0 else 0
    chunks = across(r0, rows, meta.chunks[y]) * across(c0, cols, meta.chunks[x])
    free = [k for k in range(len(meta.shape)) if k not in (y, x) and meta.dims[k] not in (pins or {})]
    if free and any(meta.shape[k] > 1 for k in free):
        raise ValueError(f"these dimensions need a pin: {', '.join(meta.dims[k] for k in free)}")
    return {"rows": math.ceil(rows / step) * math.ceil(cols / step), "chunks": chunks, "bytes": chunks * math.prod(meta.chunks) * np.dtype(meta.dtype).itemsize}


def default_plan(meta: ArrayMeta, rows: int = 200_000, size: int = 256 << 20) -> dict:
    """Pins, window and step that show an array of any size: ``pins, window, step, narrowed``.

    Other dimensions are pinned at 0. The window is the whole array if its chunks are at most ``size`` bytes, unpacked; else
    the square of whole chunks in its middle that is, at least one chunk. The step is the least that leaves at most about
    ``rows`` cells of it.
    """
    y, x = meta.axes
    each = math.prod(meta.chunks) * np.dtype(meta.dtype).itemsize
    side = max(1, math.isqrt(max(size // each, 1)))

    def middle(axis: int) -> tuple[int, int]:
        length, chunk = meta.shape[axis], meta.chunks[axis]
        span = min(length, side * chunk)
        first = (length - span) // 2 // chunk * chunk
        return first, min(span, length - first)

    (r0, n), (c0, m) = middle(y), middle(x)
    pins = {d: 0 for k, d in enumerate(meta.dims) if k not in (y, x)}
    step = max(1, math.ceil(math.sqrt(n * m / rows))) if rows else 1
    return {"pins": pins, "window": (r0, c0, n, m), "step": step, "narrowed": n < meta.shape[y] or m < meta.shape[x]}


def preview_zarr(spark: SparkSession, path: str, rows: int = 200_000, size: int = 256 << 20, **options) -> Layer:
    """``read_zarr`` by the default plan: an array of any size, within a budget of cells and of bytes that are read."""
    plan = default_plan(array_meta(spark, path.rstrip("/")), rows, size)
    return read_zarr(spark, path, pins=plan["pins"], window=plan["window"], step=plan["step"], **options)


def read_zarr(
    spark: SparkSession, path: str, pins: dict[str, int] | None = None, window: tuple[int, int, int, int] | None = None, step: int = 1, geometry: str = "point", skip_nodata: bool = True, value: str = "value", crs: str | None = None
) -> Layer:
    """A row for each cell of one array: ``y_index, x_index, x, y``, the pins, the value, and a point or footprint.

    Other dimensions are pinned. The stride counts from the window's corner. Values are scaled by ``scale_factor`` and
    ``add_offset``; cells that hold the fill value (``_FillValue``, ``missing_value``) or no number are left out, or null.
    Places come from ``transform`` (six numbers, row by row) or ``GeoTransform`` attributes, else they are the indexes.
    Only the chunks that the window touches are listed and read, in parallel; chunks that aren't stored are all fill.
    """
    pins, path = dict(pins or {}), path.rstrip("/")
    meta = array_meta(spark, path)
    zarr_plan(meta, pins, window, step)
    y, x = meta.axes
    r0, c0, rows, cols = window or (0, 0, meta.shape[y], meta.shape[x])
    r1, c1 = min(r0 + rows, meta.shape[y]), min(c0 + cols, meta.shape[x])
    index = [[pins.get(meta.dims[k], 0) // meta.chunks[k]] for k in range(len(meta.shape))]
    index[y] = range(r0 // meta.chunks[y], (r1 - 1) // meta.chunks[y] + 1) if r1 > r0 else range(0)
    index[x] = range(c0 // meta.chunks[x], (c1 - 1) // meta.chunks[x] + 1) if c1 > c0 else range(0)
    a = meta.attrs
    t = a.get("transform") or a.get("spatial:transform")
    if not t and a.get("GeoTransform"):
        g = [float(v) for v in (a["GeoTransform"].split() if isinstance(a["GeoTransform"], str) else a["GeoTransform"])]
        t = [g[1], g[2], g[0], g[4], g[5], g[3]]
    t = [float(v) for v in (t or [1, 0, 0, 0, 1, 0])[:6]]
    scale, offset = a.get("scale_factor"), a.get("add_offset")
    noted = [v for n in NODATA_NAMES for v in (a[n] if isinstance(a.get(n), list) else [a.get(n)])]
    missing = [float(v) for v in (*noted, meta.fill) if isinstance(v, (int, float))]
    floats = scale is not None or offset is not None or np.dtype(meta.dtype).kind == "f"

    def cells(grid: np.ndarray, iy: int, ix: int) -> pa.RecordBatch:
        rr, cc = np.arange(grid.shape[0]) + iy * meta.chunks[y], np.arange(grid.shape[1]) + ix * meta.chunks[x]
        rk, ck = (rr >= r0) & (rr < r1) & ((rr - r0) % step == 0), (cc >= c0) & (cc < c1) & ((cc - c0) % step == 0)
        v = grid[rk][:, ck].astype(float).ravel()
        r, c = (m.ravel() for m in np.meshgrid(rr[rk], cc[ck], indexing="ij"))
        empty = np.isnan(v)
        for m in missing:
            empty |= v == m
        v = v * (1.0 if scale is None else float(scale)) + (0.0 if offset is None else float(offset))
        keep = ~empty if skip_nodata else np.ones(len(v), bool)
        v, r, c, empty = v[keep], r[keep], c[keep], empty[keep]
        px, py = c + 0.5, r + 0.5
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(t[0] * px + t[1] * py + t[2]), pa.array(t[3] * px + t[4] * py + t[5]), pa.array(v, mask=empty)], ["y_index", "x_index", "x", "y", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                iy, ix = b.column("iy")[k].as_py(), b.column("ix")[k].as_py()
                raw = b.column("content")[k].as_py()
                if raw is None:
                    block = np.full(meta.chunks, np.nan if meta.fill is None else float(meta.fill))
                else:
                    block = np.frombuffer(unpacked(raw, meta.codec), meta.dtype).reshape(meta.chunks, order=meta.order)
                at = tuple(slice(None) if d in (y, x) else pins.get(meta.dims[d], 0) % meta.chunks[d] for d in range(len(meta.shape)))
                grid = block[at]
                yield cells(grid if y < x else grid.T, iy, ix)

    # The chunks that the window touches, by a pattern that only their files fit, so that no other file is listed or read.
    spelled = lambda k: str(index[k][0]) if len(index[k]) == 1 else "{" + ",".join(map(str, index[k])) + "}" if 0 < len(index[k]) <= SPELLED else "*"
    pattern = f"{path}/{meta.prefix}{meta.separator.join(spelled(k) for k in range(len(meta.shape)))}"
    numbers = re.escape(meta.separator).join(r"(\d+)" for _ in meta.shape)
    inside = F.col("iy").between(r0 // meta.chunks[y], (r1 - 1) // meta.chunks[y]) & F.col("ix").between(c0 // meta.chunks[x], (c1 - 1) // meta.chunks[x])
    stored = None
    if index[y] and index[x] and matches(spark, pattern):
        place = lambda k: F.regexp_extract("path", rf"{numbers}$", k + 1).cast("long")
        stored = spark.read.format("binaryFile").load(pattern).select(place(y).alias("iy"), place(x).alias("ix"), "content").where(inside)
    parts = [] if stored is None else [stored.mapInArrow(run, _CELLS)]
    if index[y] and index[x] and not (skip_nodata and (meta.fill is None or float(meta.fill) in missing)):
        # Chunks that aren't stored are all fill, and only matter if that is a value or is asked for.
        wide = len(index[x])
        every = spark.range(len(index[y]) * wide).select((F.col("id") / wide).cast("long").alias("iy"), (F.col("id") % wide).alias("ix"))
        every = every.select((F.col("iy") + index[y][0]).alias("iy"), (F.col("ix") + index[x][0]).alias("ix"))
        lacking = every if stored is None else every.join(stored.select("iy", "ix"), ["iy", "ix"], "left_anti")
        parts.append(lacking.select("iy", "ix", F.lit(None).cast("binary").alias("content")).mapInArrow(run, _CELLS))
    df = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _CELLS)
    df = df.select("y_index", "x_index", "x", "y", *[F.lit(v).alias(k) for k, v in pins.items()], F.col("value").cast("double" if floats else "bigint").alias(value))
    source = known_crs(crs or next((_code(a[n]) for n in CRS_NAMES if a.get(n)), LON_LAT))
    if geometry == "point":
        return layer(df.withColumn("geometry", geo.st_point(F.col("x"), F.col("y"))), "geometry", source)
    if geometry == "footprint":
        w, h = abs(t[0]) * step / 2, abs(t[4]) * step / 2
        return layer(df.withColumn("geometry", geo.st_box(F.col("x") - w, F.col("y") - h, F.col("x") + w, F.col("y") + h)), "geometry", source)
    return layer(df, crs=source)


def _code(v) -> str:
    text = str(v)
    return f"EPSG:{text}" if text.isdigit() else text
