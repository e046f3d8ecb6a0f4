"""Writing layers: Parquet, GeoParquet, GeoJSON and CSV."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import delete_path, fresh_path, matches, put_bytes
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, is_lon_lat, need_geometry
from geoloom.operators.h3 import cell_number

#: The column that holds cells; a fixed name.
CELLS = "h3_index"
FORMATS = ("Parquet", "GeoParquet", "GeoJSON", "CSV")


def write(l: Layer, path: str, format: str = "Parquet") -> None:
    """Write a layer below ``path``, a file for each partition, by Spark's own writers.

    A layer without geometry that has a column ``h3_index`` is written to the spatial formats with its cells as hexagons, a
    null where there is none.
    """
    if format in ("GeoParquet", "GeoJSON") and not l.geometry and dict(l.df.dtypes).get(CELLS) in ("string", "bigint"):
        n = col(CELLS) if dict(l.df.dtypes)[CELLS] == "bigint" else cell_number(col(CELLS))
        l = Layer(l.df.select(*[col(c) for c in l.columns if c != "geometry"], geo.cell_shape(n).alias("geometry")), "geometry")
    if format == "Parquet":
        l.df.write.parquet(path)
    elif format == "GeoParquet":
        _geoparquet(l, path) if l.geometry else l.df.write.parquet(path)
    elif format == "GeoJSON":
        geojson_features(l).write.text(path)
    elif format == "CSV":
        (l.df.withColumn(l.geometry, geo.st_astext(col(l.geometry))) if l.geometry else l.df).write.csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {format}; known are {', '.join(FORMATS)}")


def safe_name(name: str) -> str:
    """A file name of letters, digits, points, dashes and underscores, without a known ending."""
    stem = re.sub(r"(?i)\.(parquet|pq|geojson|json|csv|tsv|gz)$", "", name)
    return re.sub(r"[^\w.-]", "_", stem) or "output"


def geojson_features(l: Layer) -> DataFrame:
    """One GeoJSON feature a row, as text: a sequence that other tools read line by line.

    A projected layer keeps its coordinates and names its system in each feature. A null geometry is null.
    """
    g = need_geometry(l)
    rest = [c for c in l.columns if c != g]
    properties = F.to_json(F.struct(*map(col, rest)), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    shape = F.coalesce(geo.st_asgeojson(col(g)), F.lit("null"))
    crs = "" if is_lon_lat(l.crs) else f', "crs": {{"type": "name", "properties": {{"name": "{urn(l.crs)}"}}}}'
    return l.df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit(crs + "}")).alias("value"))


def urn(crs: str) -> str:
    head, _, code = crs.partition(":")
    return f"urn:ogc:def:crs:{head}::{code}" if code else crs


def geo_metadata(l: Layer) -> dict:
    """The ``geo`` entry of a GeoParquet footer; lon/lat is the format's default system and written as none."""
    authority, _, code = l.crs.partition(":")
    crs = None if is_lon_lat(l.crs) else {"type": "ProjectedCRS", "name": l.crs, "id": {"authority": authority, "code": int(code) if code.isdigit() else code}} if code else l.crs
    return {"version": "1.1.0", "primary_column": l.geometry, "columns": {l.geometry: {"encoding": "WKB", "geometry_types": [], "crs": crs}}}


def _geoparquet(l: Layer, path: str) -> None:
    """Parquet by Spark's writer, whose files are then copied, row groups as they are, with the ``geo`` entry in the footer.

    The files are copied by as many tasks as there are files; the folder is marked as whole when all are.
    """
    spark = l.df.sparkSession
    geo.register(spark)
    raw, path = fresh_path(spark, "geoparquet"), path.rstrip("/")
    if matches(spark, path):
        raise ValueError(f"{path} exists already")
    l.df.write.parquet(raw)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(raw).select("path")
    target = F.concat(F.lit(f"{path}/"), F.element_at(F.split("path", "/"), -1))
    n = files.count()
    copied = files.repartition(max(n, 1), "path").select(F.call_function("geo_footer", "path", target, F.lit(json.dumps(geo_metadata(l)))).alias("rows"))
    copied.agg(F.sum("rows")).collect()
    put_bytes(spark, f"{path}/_SUCCESS", b"")
    delete_path(spark, raw)
