"""Many workbooks or GeoPackages at once: each file is opened in the task that reads it."""

from __future__ import annotations

import datetime as dt
import io
import re
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.values import col
from geoloom.layer import LON_LAT, Layer, known_crs, layer

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats of dates and times; fixed values of the file format.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def workbook_cells(raw: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """``(sheet, row, column, kind, text)`` of every filled cell, rows and columns from 0; kinds are n, b, d and s."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        parse = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            xfs = styles.find(f"{_MAIN}cellXfs")
            for k, xf in enumerate(xfs if xfs is not None else []):
                n = int(xf.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, ""))
                if n in DATE_FORMATS or re.search(r"[ymdhs]", code.lower()):
                    dates.add(k)
        rels = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        for sheet in parse("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            target = rels[sheet.get(f"{_REL}id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for c in parse(part).iter(f"{_MAIN}c"):
                ref = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else v.text if v is not None else None
                if ref is None or text is None:
                    continue
                column = 0
                for letter in ref[1]:
                    column = column * 26 + ord(letter) - 64
                kind, place = c.get("t", "n"), (sheet.get("name"), int(ref[2]) - 1, column - 1)
                if kind == "s":
                    yield (*place, "s", shared[int(text)])
                elif kind == "b":
                    yield (*place, "b", "true" if text == "1" else "false")
                elif kind == "n" and int(c.get("s", 0)) in dates:
                    when = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(text) * 86400))
                    yield (*place, "d", when.isoformat(sep=" "))
                elif kind == "n":
                    yield (*place, "n", text)
                elif kind != "e":
                    yield (*place, "s", text)


def cells(spark: SparkSession, glob: str) -> DataFrame:
    """``file, sheet, row, column, kind, text`` of all workbooks that the pattern matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = [(b.column(0)[k].as_py(), *c) for c in workbook_cells(b.column(1)[k].as_py())]
                if rows:
                    f, s, r, c, kind, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(s), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(kind), pa.array(text)], ["file", "sheet", "row", "column", "kind", "text"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInArrow(run, "file string, sheet string, row int, `column` int, kind string, text string")


def read_workbooks(spark: SparkSession, glob: str, sheet: str | None = None, header_row: int | None = None) -> Layer:
    """One sheet (the first by name if none is given) of all workbooks as one table, with ``file``.

    Without ``header_row`` the header is the first row that is at least half as wide as the widest and mostly text.
    Blank names become ``column_n``, repeated ones get ``_2``. A column has a type only if every cell agrees: whole
    numbers, decimals, booleans, dates if all are at midnight, else timestamps; otherwise it is text.
    """
    every = cells(spark, glob)
    if sheet is None:
        first = every.agg(F.min("sheet")).first()[0]
        if first is None:
            return layer(spark.createDataFrame([], "file string"))
        sheet = first
    own = every.where(F.col("sheet") == sheet)
    if header_row is None:
        rows = own.groupBy("file", "row").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "s").alias("s"))
        widest = rows.agg(F.max("n")).first()[0] or 0
        header_row = rows.where((F.col("n") * 2 >= widest) & (F.col("s") >= 0.6 * F.col("n"))).agg(F.min("row")).first()[0] or 0
    # Columns of a sheet are few; their names and types are all that the driver sees.
    body = own.where(F.col("row") > header_row)
    kinds = {r["column"]: r for r in body.groupBy("column").agg(F.collect_set("kind").alias("kinds"), F.min((F.col("text").try_cast("double") % 1 == 0)).alias("whole"), F.min(F.col("text").endswith("00:00:00")).alias("midnight")).collect()}
    heads = {r["column"]: r["text"] for r in own.where(F.col("row") == header_row).groupBy("column").agg(F.first("text").alias("text")).collect()}
    names: dict[int, str] = {}
    for c in sorted(set(heads) | set(kinds)):
        base = (heads.get(c) or "").strip() or f"column_{c + 1}"
        name, k = base, 1
        while name in names.values():
            k += 1
            name = f"{base}_{k}"
        names[c] = name
    wide = body.groupBy("file", "row").pivot("column", sorted(names)).agg(F.first("text")) if names else body.select("file", "row").distinct()

    def typed(c: int):
        r = kinds.get(c)
        found = set(r["kinds"]) if r else set()
        kind = {frozenset("n"): "bigint" if r and r["whole"] else "double", frozenset("b"): "boolean", frozenset("d"): "date" if r and r["midnight"] else "timestamp_ntz"}.get(frozenset(found), "string")
        source = col(str(c))
        return (source.try_cast("double").cast("bigint") if kind == "bigint" else source.try_cast(kind)).alias(names[c])

    return layer(wide.orderBy("file", "row").select("file", *[typed(c) for c in names]))


def _strip(blob: bytes | None) -> bytes | None:
    """Plain WKB from a GeoPackage geometry: without its header and envelope; null if it is empty."""
    if blob is None or blob[:2] != b"GP":
        return blob
    flags = blob[3]
    if flags >> 4 & 1:
        return None
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7] :]


def _opened(raw: bytes) -> tuple[sqlite3.Connection, tempfile._TemporaryFileWrapper]:
    f = tempfile.NamedTemporaryFile(suffix=".gpkg")  # in the task's own folder, gone with it
    f.write(raw)
    f.flush()
    return sqlite3.connect(f"file:{f.name}?mode=ro", uri=True), f


def geopackage_layers(spark: SparkSession, glob: str) -> DataFrame:
    """``file, layer, geometry, srs, columns`` of all layers of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                db, _f = _opened(b.column(1)[k].as_py())
                rows = db.execute("SELECT g.table_name, g.column_name, s.organization || ':' || s.organization_coordsys_id FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s USING (srs_id)").fetchall()
                out = [(b.column(0)[k].as_py(), t, g, srs, [f"{c[1]} {c[2]}" for c in db.execute(f'PRAGMA table_info("{t}")')]) for t, g, srs in rows]
                db.close()
                if out:
                    f, t, g, s, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(t), pa.array(g), pa.array(s, pa.string()), pa.array(c, pa.list_(pa.string()))], ["file", "layer", "geometry", "srs", "columns"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInArrow(run, "file string, layer string, geometry string, srs string, columns array<string>")


_SQLITE = {"INT": ("bigint", pa.int64()), "REAL": ("double", pa.float64()), "DOUB": ("double", pa.float64()), "FLOA": ("double", pa.float64()), "BLOB": ("binary", pa.binary()), "BOOL": ("boolean", pa.bool_())}


def read_geopackage(spark: SparkSession, glob: str, name: str | None = None) -> Layer:
    """One layer (the first if none is given) of all files as one table, its ``fid`` kept, its geometry as WKB."""
    found = geopackage_layers(spark, glob)
    head = (found.where(F.col("layer") == name) if name else found).orderBy("file", "layer").limit(1).collect()
    if not head:
        raise ValueError(f"no layer {name or ''} in {glob}")
    name, geometry, srs = head[0]["layer"], head[0]["geometry"], head[0]["srs"]
    columns = []
    for c in head[0]["columns"]:
        n, _, kind = c.rpartition(" ")
        kinds = ("binary", pa.binary()) if n == geometry else next((v for k, v in _SQLITE.items() if k in kind.upper()), ("string", pa.string()))
        columns.append((n, *kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                db, _f = _opened(b.column(0)[k].as_py())
                cursor = db.execute("SELECT {} FROM \"{}\"".format(", ".join(f'"{n}"' for n, *_ in columns), name))
                while rows := cursor.fetchmany(5000):
                    cols = list(zip(*rows, strict=True))
                    arrays = []
                    for (n, kind, t), values in zip(columns, cols, strict=True):
                        fix = _strip if n == geometry else (lambda v: None if v is None else bool(v)) if kind == "boolean" else (lambda v: None if v is None else str(v)) if kind == "string" else (lambda v: v)
                        arrays.append(pa.array([fix(v) for v in values], t))
                    yield pa.RecordBatch.from_arrays(arrays, [n for n, *_ in columns])
                db.close()

    files = spark.read.format("binaryFile").load(glob).select("content")
    df = files.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k, _ in columns))
    try:
        crs = known_crs(srs)
    except ValueError:
        crs = LON_LAT
    return layer(df, geometry, crs)


def geopackage_geometry(wkb: bytes, srs: int = 4326) -> bytes:
    """WKB with a GeoPackage header without envelope."""
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + wkb
