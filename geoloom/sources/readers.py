"""Reading layers. Layers read from a declared projected system are moved to lon/lat."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from geoloom.cluster import fresh_path
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import LON_LAT, Layer, find_geometry, is_lon_lat, known_crs, layer
from geoloom.operators.geometry import reproject
from geoloom.operators.h3 import position_shapes, positional
from geoloom.sources import arrays, rasters, tables
from geoloom.sources.features import feature_lines

FORMATS = {
    ".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "csv", ".gz": "csv", ".geojson": "geojson", ".json": "geojson", ".gpkg": "geopackage", ".xlsx": "workbook", ".xlsm": "workbook",
    ".tif": "raster", ".tiff": "raster", ".zarr": "zarr",
}
#: Delimiters that are tried on the head of a text file.
DELIMITERS = (",", ";", "\t", "|")


def read(spark: SparkSession, path: str, format: str | None = None, crs: str | None = None, row_number: bool | None = None, **options) -> Layer:
    """One source as a lon/lat layer; the format follows from the ending if it isn't given.

    Parquet has ``file_row_number``, the place in its file, if that is wanted; without a word, if the file is a dense tile:
    named after a cell, with as many rows as that has descendants at some resolution, and no column of cells.

    ``crs`` overrides what the file says. A system that is only assumed is never moved from. ``options`` are those of the
    format's own reader: the sheet of a workbook, the layer of a GeoPackage, the pins, window and step of a Zarr array.
    """
    if format is None:
        ending = re.search(r"\.\w+$", path.rstrip("/").lower())
        format = FORMATS.get(ending[0] if ending else "", "parquet")
    if format == "parquet":
        if row_number is None:
            row_number = dense_tile(spark, path) is not None
        l, declared = read_parquet(spark, path, row_number)
    elif format == "csv":
        l, declared = read_csv(spark, path), None
    elif format == "geojson":
        l, declared = read_geojson(spark, path)
    elif format == "geopackage":
        l, declared = tables.read_geopackage(spark, path, **options), None
    elif format == "workbook":
        l, declared = tables.read_workbooks(spark, path, **options), None
    elif format == "raster":
        l, declared = rasters.read_raster(spark, path)[0], None
    elif format == "zarr":
        l = arrays.read_zarr(spark, path, crs=crs, **options)
        declared = l.crs
    else:
        raise ValueError(f"unknown format: {format}")
    source = known_crs(crs or declared or l.crs)
    l = Layer(l.df, l.geometry, source)
    return reproject(l, LON_LAT) if l.geometry and not is_lon_lat(source) else l


def read_parquet(spark: SparkSession, path: str, row_number: bool = False) -> tuple[Layer, str | None]:
    """Parquet with its geometry column, and with ``file_row_number``, the place in its file, if wanted.

    If the files' footers have the ``geo`` entry of GeoParquet, that names the geometry and its system, which is
    returned as well. One footer is read for it.
    """
    df = spark.read.parquet(path)
    said = geo_entry(spark, df)
    geometry = said.get("primary_column") if said.get("primary_column") in df.columns else None
    if row_number:
        df = df.select("*", F.col("_metadata.row_index").alias("file_row_number"))
    return layer(df, geometry), crs_of(said)


def geo_entry(spark: SparkSession, df: DataFrame) -> dict:
    """The ``geo`` entry in the footer of the first of a DataFrame's files; empty if there is none."""
    files = sorted(df.inputFiles())[:1]
    if not files:
        return {}
    hadoop = spark._jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(files[0]), spark._jsc.hadoopConfiguration()))
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(text) if text else {}


def crs_of(entry: dict) -> str | None:
    """The system that a ``geo`` entry declares: an explicit null is lon/lat; without a word it is unknown."""
    column = entry.get("columns", {}).get(entry.get("primary_column"), {})
    crs = column.get("crs", "")
    if crs is None:
        return LON_LAT
    if isinstance(crs, dict):
        own = crs.get("id") or {}
        return f"{own['authority']}:{own['code']}" if own.get("authority") and own.get("code") else crs.get("name")
    return crs or None


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> Layer:
    """Delimited text with a header, types found from the data; the delimiter is the one the first line has most of."""
    if delimiter is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0][0] if head else ""
        delimiter = max(DELIMITERS, key=line.count)
    return layer(spark.read.csv(path, header=True, inferSchema=True, sep=delimiter))


def read_geojson(spark: SparkSession, path: str, lines: bool | None = None) -> tuple[Layer, str | None]:
    """Features of a collection, or one a line, with their properties as columns and ``geometry`` last.

    A collection is cut into its features by many tasks, however large the file, and these are written as lines first. The
    schema of the properties comes from one pass over the data. Text that isn't GeoJSON is an error. The system that
    a collection's ``crs`` member names, or that of its first feature that has one, is returned as well.
    """
    kind = StructType([StructField("type", StringType()), StructField("coordinates", StringType())])
    if lines is None:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        lines = bool(first) and re.match(r'\s*\{.*"type"\s*:\s*"Feature"', first[0][0]) is not None
    beside: list[str] = []
    if not lines:
        features, beside = feature_lines(spark, path)
        path, source = fresh_path(spark, "features"), path
        features.write.text(path)
    found = spark.read.json(path).schema
    if lines and "features" in found.names and "geometry" not in found.names:  # a collection may stand in one line, which names its features' type as well
        return read_geojson(spark, path, lines=False)
    said = [_members(t) for t in beside]
    if not lines and not any(isinstance(m.get("features"), list) for m in said) or lines and "geometry" not in found.names:
        raise ValueError(f"{path if lines else source} isn't GeoJSON: it has no features")
    feature = found
    # Coordinates nest to different depths from shape to shape, so they are read as the text they are.
    own = feature["properties"].dataType if "properties" in feature.names else None
    names = own.names if isinstance(own, StructType) else []
    feature = StructType([*([feature["properties"]] if names else []), StructField("geometry", kind)])
    features = spark.read.schema(feature).json(path).select(F.struct("*").alias("f"))
    shape = geo.st_geomfromgeojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    l = layer(features.select(*[F.col(f"f.properties.`{n}`").alias(n) for n in names], shape.alias("geometry")), "geometry")
    named = next((n for m in said if (n := _system(m))), None)
    if lines and "crs" in found.names:
        first = spark.read.schema("crs struct<properties: struct<name: string>>").json(path).where("crs.properties.name IS NOT NULL").select("crs.properties.name").limit(1).collect()
        named = first[0][0] if first else None
    return l, crs_named(named) if named else None


def _members(text: str) -> dict:
    """A document's members; none if it isn't a JSON object."""
    try:
        found = json.loads(text.lstrip("\ufeff"))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _system(members: dict) -> str | None:
    crs = members.get("crs")
    named = crs.get("properties") if isinstance(crs, dict) else None
    return named.get("name") if isinstance(named, dict) else None


def crs_named(name: str) -> str:
    """The code in a name such as ``urn:ogc:def:crs:EPSG::2056`` or ``EPSG:2056``."""
    urn = re.fullmatch(r"urn:ogc:def:crs:(\w+):[^:]*:(\w+)", name.strip())
    return f"{urn[1]}:{urn[2]}" if urn else name.strip()


def read_postgis(spark: SparkSession, url: str, table: str, geometry: str | None = None, crs: str = LON_LAT, **options: str) -> Layer:
    """A PostGIS table by JDBC, its geometry as WKB; the user supplies the driver, and bounds to read in parallel."""
    source = f"(SELECT t.*, ST_AsBinary(t.{geometry}) AS wkb_geometry FROM {table} t) q" if geometry else table
    df = spark.read.format("jdbc").options(url=url, dbtable=source, **options).load()
    if geometry:
        df = df.drop(geometry).withColumnRenamed("wkb_geometry", geometry)
    return layer(df, geometry, crs)


#: Columns that hold cell numbers, by their usual names; fixed values.
H3_COLUMNS = ("h3_index", "h3index", "cell", "cell_id", "h3", "h3_cell", "index")


#: Base cells that are pentagons, with six children; fixed values.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def named_cell(path: str) -> str | None:
    """The cell that a file is named after: 15 or 16 hexadecimal digits, a number may stand before them."""
    stem = re.sub(r"(?i)\.(parquet|pq)$", "", path.rstrip("/").rpartition("/")[2]).rpartition("_")[2].lower()
    if not re.fullmatch(r"0?8[0-9a-f]{14}", stem):
        return None
    n = int(stem, 16)
    resolution, digits = (n >> 52) & 15, [(n >> 3 * (15 - r)) & 7 for r in range(1, 16)]
    good = (n >> 56) == 8 and (n >> 45) & 127 < 122 and all((d == 7) == (r > resolution) for r, d in enumerate(digits, 1))
    return f"{n:015x}" if good else None


def is_pentagon(cell: str) -> bool:
    n = int(cell, 16)
    return (n >> 45) & 127 in PENTAGONS and all((n >> 3 * (15 - r)) & 7 == 0 for r in range(1, ((n >> 52) & 15) + 1))


def describe_h3(l: Layer, path: str, rows: int) -> dict:
    """How a file relates to the grid: the parent that it is named after, its column of cells, or how deep its rows fill the parent."""
    parent = named_cell(path)
    kinds = dict(l.df.dtypes)
    index = next((c for c in l.columns if c.lower() in H3_COLUMNS and kinds[c] in ("string", "bigint", "int")), None)
    depth = next((k for k in range(16) if 7**k == rows), None)
    if not parent or index or (depth and (is_pentagon(parent) or ((int(parent, 16) >> 52) & 15) + depth > 15)):
        depth = None
    return {"parent": parent, "index": index, "depth": depth}


def dense_tile(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The parent and the rows' resolution, if a Parquet file is a dense tile; rows are counted by its footer."""
    if not named_cell(path):
        return None
    df = spark.read.parquet(path)
    found = describe_h3(Layer(df), path, df.count())
    return None if found["depth"] is None else (found["parent"], ((int(found["parent"], 16) >> 52) & 15) + found["depth"])


def read_tile(spark: SparkSession, path: str, shapes: bool = False, index: str = "h3_index") -> Layer:
    """A dense tile with its rows' cells, and their hexagons if wanted; an error if the file isn't one."""
    tile = dense_tile(spark, path)
    if not tile:
        raise ValueError(f"{path} is no dense tile: its name must be a cell's and its rows as many as that has descendants")
    l = read(spark, path, "parquet", row_number=True)
    return (position_shapes if shapes else positional)(l, *tile, index=index)


def geometry_of(l: Layer) -> str | None:
    return l.geometry or find_geometry(l.df.schema)


def text_points(l: Layer, wkt: str, geometry: str = "geometry") -> Layer:
    """A column of WKT as geometry."""
    return layer(l.df.select(*[col(c) for c in l.columns if c != wkt], geo.st_geomfromtext(col(wkt)).alias(geometry)), geometry, l.crs)
