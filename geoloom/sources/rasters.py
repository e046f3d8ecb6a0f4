"""GeoTIFF files as footprints and as a table of tiles, read by ranges: tags first, then the blocks that are asked for."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, layer

HEAD = ("raster", "width", "height", "bands", "data_type", "nodata", "crs", "transform")


@dataclass(frozen=True)
class Rasters:
    """GeoTIFF files by their tags: ``raster`` (the path), ``HEAD``'s columns, and the blocks' size ``bw, bh``."""

    heads: DataFrame

    @property
    def footprints(self) -> Layer:
        """A row for each file with its outline."""
        t = F.col("transform")
        corner = lambda i, j: (t[0] * i + t[1] * j + t[2], t[3] * i + t[4] * j + t[5])
        corners = [corner(i, j) for i in (F.lit(0), F.col("width")) for j in (F.lit(0), F.col("height"))]
        xs, ys = zip(*corners, strict=True)
        outline = geo.st_box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
        return layer(self.heads.select(*map(col, HEAD), F.abs(t[0]).alias("pixel_x"), F.abs(t[4]).alias("pixel_y"), outline.alias("geometry")), "geometry")

    @property
    def blocks(self) -> DataFrame:
        """A row for each band and block, without its values: ``raster, band, bx, by, x0, y0, w, h, bw, bh, transform``."""
        every = lambda c, size: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / F.col(size)).cast("int")))
        b = self.heads.where("width > 0 AND height > 0").withColumn("by", every("height", "bh")).withColumn("bx", every("width", "bw"))
        b = b.withColumn("x0", F.col("bx") * F.col("bw")).withColumn("y0", F.col("by") * F.col("bh")).withColumn("band", F.explode(F.sequence(F.lit(1), "bands")))
        rest = lambda c, first, size: F.least(F.col(c) - F.col(first), F.col(size)).alias({"width": "w", "height": "h"}[c])
        return b.select("raster", "band", "bx", "by", "x0", "y0", rest("width", "x0", "bw"), rest("height", "y0", "bh"), "bw", "bh", "transform")

    @property
    def tiles(self) -> DataFrame:
        """The blocks with ``pixels``, dealt to all tasks; nodata and no numbers are null."""
        b = self.blocks.repartition("raster", "bx", "by")
        return b.withColumn("pixels", geo.tiff_pixels(F.col("raster"), F.col("band"), F.col("bx"), F.col("by")))


def open_rasters(spark: SparkSession, glob: str) -> Rasters:
    """All files that a pattern names; of each only the tags are read, by the tasks that list it."""
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("raster"))
    return Rasters(files.withColumn("head", geo.tiff_head(F.col("raster"))).select("raster", "head.*"))


def read_raster(spark: SparkSession, glob: str) -> tuple[Layer, DataFrame]:
    """``(footprints, tiles)`` of all files."""
    found = open_rasters(spark, glob)
    return found.footprints, found.tiles


def geotiff(grid: np.ndarray, transform: tuple[float, ...], nodata: float | None = None, side: int = 256, epsg: int = 4326) -> bytes:
    """A grid of one machine's size as a GeoTIFF of 32-bit floats in deflated square tiles, north up."""
    h, w = grid.shape
    blocks = []
    for y in range(0, h, side):
        for x in range(0, w, side):
            own = grid[y : y + side, x : x + side]
            blocks.append(zlib.compress(np.pad(own, ((0, side - own.shape[0]), (0, side - own.shape[1]))).astype("<f4").tobytes(), 1))
    starts = (8 + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])).tolist()
    geographic = 2048 if epsg == 4326 else 3072
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [32]), (259, "H", [8]), (277, "H", [1]), (322, "I", [side]), (323, "I", [side]), (324, "I", starts[:-1]), (325, "I", [len(b) for b in blocks]), (339, "H", [3])]
    tags += [(33550, "d", [transform[0], -transform[4], 0.0]), (33922, "d", [0.0, 0.0, 0.0, transform[2], transform[5], 0.0]), (34735, "H", [1, 1, 0, 1, geographic, 0, 1, epsg])]
    tags += [(42113, "s", [f"{nodata}".encode() + b"\0"])] if nodata is not None else []
    at, entries, extra = starts[-1] + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in tags:
        raw = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], len(raw) if code == "s" else len(values)) + place
    return b"II*\0" + struct.pack("<I", starts[-1]) + b"".join(blocks) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra
