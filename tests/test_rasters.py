import json
import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.layer import layer
from geoloom.operators import raster
from geoloom.sources import arrays, rasters, tables


def tiff(path, grid, tile=None, deflate=True, nodata=None):
    """A small GeoTIFF: strips of two rows or square tiles, one band of 32-bit floats, pixel size 1, north up."""
    h, w = grid.shape
    bw, bh = (tile, tile) if tile else (w, 2)
    data = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            block = grid[y : y + bh, x : x + bw].astype("<f4")
            if tile:
                block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
            data.append(zlib.compress(block.tobytes()) if deflate else block.tobytes())
    ends = np.cumsum([8, *map(len, data)])
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (277, 3, [1]), (339, 3, [3]), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0, 0, 0, 10.0, 20.0, 0])]
    tags += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, ends[:-1].tolist()), (325, 4, list(map(len, data)))] if tile else [(278, 4, [bh]), (273, 4, ends[:-1].tolist()), (279, 4, list(map(len, data)))]
    tags += [(34735, 3, [1, 1, 0, 1, 2048, 0, 1, 4326])]
    text = {42113: f"{nodata}".encode() + b"\0"} if nodata is not None else {}
    all_tags = sorted([*tags, *[(k, 2, v) for k, v in text.items()]])
    ifd = int(ends[-1])
    extra_at, extra, entries = ifd + 2 + 12 * len(all_tags) + 4, b"", b""
    for tag, kind, values in all_tags:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place, extra = struct.pack("<I", extra_at + len(extra)), extra + raw
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", ifd) + b"".join(data) + struct.pack("<H", len(all_tags)) + entries + b"\0\0\0\0" + extra)


GRID = np.array([[1, 1, 2, 2, 5], [1, 3, 3, 2, 5], [1, 1, 3, 9, 5], [4, 1, 1, 9, 5]], float)


@pytest.fixture(scope="module", params=[None, 2, 16])
def tiles(spark, request):
    d = tempfile.mkdtemp()
    tiff(f"{d}/a.tif", GRID, request.param, deflate=request.param != 16, nodata=9)
    return rasters.read_raster(spark, f"{d}/*.tif")


def test_footprint(tiles):
    f = tiles[0].df.withColumn("w", geo.st_astext(F.col("geometry"))).first()
    assert (f.width, f.height, f.bands, f.data_type, f.nodata, f.crs) == (5, 4, 1, "float32", 9.0, "EPSG:4326")
    assert f.transform == [1.0, 0.0, 10.0, 0.0, -1.0, 20.0] and f.w == "POLYGON ((10 16, 10 20, 15 20, 15 16, 10 16))"


def test_values_at_points(spark, tiles):
    rows = [(k, x, y) for k, (x, y) in enumerate([(10.5, 19.5), (11.5, 18.5), (14.9, 16.1), (13.5, 17.5), (9.9, 18.0), (10.0, 20.0)])]
    df = spark.createDataFrame(rows + [(9, None, None)], "id int, x double, y double")
    l = layer(df.withColumn("geometry", geo.st_point(F.col("x"), F.col("y"))), "geometry")
    got = {r.id: r.raster_value for r in raster.sample_raster(l, tiles[1]).df.collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 5.0, 3: None, 4: None, 5: 1.0, 9: None}
    with pytest.raises(ValueError):
        raster.sample_raster(l, tiles[1], attribute="x")


@pytest.mark.parametrize("tile", [None, 2])
def test_values_of_files_at_points(spark, tmp_path, tile):
    tiff(f"{tmp_path}/a.tif", GRID, tile, nodata=9)
    tiff(f"{tmp_path}/b.tif", GRID + 100, tile, nodata=109)
    rows = [(k, x, y) for k, (x, y) in enumerate([(10.5, 19.5), (11.5, 18.5), (14.9, 16.1), (13.5, 17.5), (9.9, 18.0), (10.0, 20.0)])]
    df = spark.createDataFrame(rows + [(9, None, None)], "id int, x double, y double")
    l = layer(df.withColumn("geometry", geo.st_point(F.col("x"), F.col("y"))), "geometry")
    got = {r.id: r.raster_value for r in raster.sample_raster(l, rasters.open_rasters(spark, f"{tmp_path}/*.tif")).df.collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 5.0, 3: None, 4: None, 5: 1.0, 9: None}


def test_areas_of_equal_value(tiles):
    out = raster.raster_to_polygons(tiles[1]).df
    got = sorted((r.value, r.a) for r in out.select("value", geo.st_area(F.col("geometry")).alias("a")).collect())
    assert got == [(1.0, 7.0), (2.0, 3.0), (3.0, 3.0), (4.0, 1.0), (5.0, 4.0)]


def packed(grid, kind, coding, predictor, tile, big=False, end="<", planes=False):
    """A TIFF of any byte order, size of offsets, sample type, predictor and compression, by hand."""
    h, w, bands = grid.shape
    n = np.dtype(kind).itemsize
    blocks = []
    for plane in range(bands if planes else 1):
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                own = grid[y : y + tile, x : x + tile, plane : plane + 1] if planes else grid[y : y + tile, x : x + tile]
                own = np.pad(own, ((0, tile - own.shape[0]), (0, tile - own.shape[1]), (0, 0))).astype(kind)
                if predictor == 2:
                    own = np.concatenate([own[:, :1], np.diff(own, axis=1)], axis=1).astype(kind)
                raw = own.astype(own.dtype.newbyteorder(end)).tobytes()
                if predictor == 3:
                    lines = np.frombuffer(own.astype(own.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(tile, -1, n)
                    flat = lines.transpose(0, 2, 1).reshape(tile, -1)
                    step = own.shape[2]
                    raw = np.concatenate([flat[:, :step], flat[:, step:] - flat[:, :-step]], axis=1).astype(np.uint8).tobytes()
                blocks.append({1: lambda r: r, 5: lzw, 8: zlib.compress, 32773: lambda r: b"".join(bytes([len(c) - 1]) + c for c in (r[i : i + 100] for i in range(0, len(r), 100))), 50000: lambda r: __import__("zstandard").compress(r)}[coding](raw))
    first = 16 if big else 8
    starts = np.cumsum([first, *map(len, blocks)]).tolist()
    code = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    tags = [(256, [w]), (257, [h]), (258, [8 * n] * bands), (259, [coding]), (277, [bands]), (284, [2 if planes else 1]), (317, [predictor]), (322, [tile]), (323, [tile]), (324, starts[:-1]), (325, list(map(len, blocks))), (339, [code] * bands)]
    at = starts[-1]
    size, extra, entries = (8, b"", b"") if big else (4, b"", b"")
    after = at + (8 if big else 2) + len(tags) * (20 if big else 12) + size
    for tag, values in tags:
        raw = struct.pack(f"{end}{len(values)}I", *values)
        if len(raw) <= size:
            place = raw.ljust(size, b"\0")
        else:
            place, extra = struct.pack(f"{end}{'Q' if big else 'I'}", after + len(extra)), extra + raw
        entries += struct.pack(f"{end}HH{'Q' if big else 'I'}", tag, 4, len(values)) + place
    head = (b"II" if end == "<" else b"MM") + (struct.pack(f"{end}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{end}HI", 42, at))
    return head + b"".join(blocks) + struct.pack(f"{end}{'Q' if big else 'H'}", len(tags)) + entries + b"\0" * size + extra


def lzw(data):
    """TIFF's LZW: codes of 9 to 12 bits, wider one code early, cleared when the table is full."""
    out, bits, held = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> bits - 8 & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for c in data:
        longer = word + bytes([c])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        if len(table) + 2 == 4095:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif len(table) + 2 > (1 << width) - 1:
            width += 1
        word = bytes([c])
    put(table[word])
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


@pytest.mark.parametrize(("kind", "coding", "predictor", "more"), [
    ("u1", 5, 1, {}), ("u1", 5, 2, {}), ("u2", 8, 2, {"end": ">"}), ("i2", 1, 2, {"big": True}), ("i4", 50000, 1, {"planes": True}), ("u4", 32773, 2, {}), ("f4", 5, 3, {}), ("f4", 8, 3, {"planes": True, "big": True}), ("f8", 8, 3, {"end": ">"}), ("f8", 1, 1, {"big": True, "end": ">"}), ("u8", 8, 2, {}), ("i1", 5, 1, {"planes": True}),
])
def test_codings(spark, tmp_path, kind, coding, predictor, more):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 120, (37, 53, 2)) if np.dtype(kind).kind == "u" else rng.integers(-120, 120, (37, 53, 2))
    grid = (grid + rng.random(grid.shape)).astype(kind) if np.dtype(kind).kind == "f" else grid.astype(kind)
    (tmp_path / "a.tif").write_bytes(packed(grid, kind, coding, predictor, 16, **more))
    out = np.full(grid.shape, np.nan)
    for r in rasters.read_raster(spark, f"{tmp_path}/*.tif")[1].collect():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w, r.band - 1] = np.array(r.pixels).reshape(r.h, r.w)
    assert (out == grid.astype(float)).all()


def test_only_touched_blocks_are_read(spark, tmp_path):
    """Points in one corner of a large file: few bytes are read, and each point has its value."""
    side = 4096
    grid = (np.arange(side)[:, None] * 3.0 + np.arange(side)[None, :]).astype("<f4")
    tiff(f"{tmp_path}/big.tif", grid, 256, deflate=False)
    size = (tmp_path / "big.tif").stat().st_size
    rng = np.random.default_rng(6)
    xy = rng.random((5000, 2)) * 500
    df = spark.createDataFrame([(k, float(x + 10), float(20 - y)) for k, (x, y) in enumerate(xy)], "id int, x double, y double")
    l = layer(df.withColumn("geometry", geo.st_point(F.col("x"), F.col("y"))), "geometry")
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    got = {r.id: r.raster_value for r in raster.sample_raster(l, rasters.open_rasters(spark, f"{tmp_path}/*.tif")).df.collect()}
    used = read() - before
    assert got == {k: float(np.float32(int(y) * 3.0 + int(x))) for k, (x, y) in enumerate(xy)}
    assert used < size / 5, (used, size)  # tables of points and the file's tags are in it
    # All points in one block, and none in the raster.
    one = l.with_df(l.df.withColumn("geometry", geo.st_point(F.lit(10.5) + F.col("id") % 3, F.lit(19.5))))
    assert {r.id % 3: r.raster_value for r in raster.sample_raster(one, rasters.open_rasters(spark, f"{tmp_path}/*.tif")).df.collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    away = l.with_df(l.df.withColumn("geometry", geo.st_point(F.lit(-50.0), F.lit(0.0))))
    assert raster.sample_raster(away, rasters.open_rasters(spark, f"{tmp_path}/*.tif")).df.where("raster_value IS NOT NULL").count() == 0


@pytest.mark.parametrize("version", [2, 3])
def test_zarr(spark, version):
    d = tempfile.mkdtemp()
    cube = np.arange(2 * 5 * 7, dtype="<i4").reshape(2, 5, 7)
    cube[1, 2, 3] = -1
    meta = {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": -1, "transform": [2.0, 0, 100.0, 0, -2.0, 50.0], "crs": "EPSG:3857"}
    if version == 2:
        with open(f"{d}/.zarray", "w") as f:
            json.dump({"zarr_format": 2, "shape": [2, 5, 7], "chunks": [1, 2, 3], "dtype": "<i4", "compressor": {"id": "zlib"}, "fill_value": None, "order": "C", "filters": None}, f)
        with open(f"{d}/.zattrs", "w") as f:
            json.dump(meta | {"_ARRAY_DIMENSIONS": ["time", "y", "x"]}, f)
    else:
        with open(f"{d}/zarr.json", "w") as f:
            json.dump({"zarr_format": 3, "node_type": "array", "shape": [2, 5, 7], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 2, 3]}}, "data_type": "int32", "chunk_key_encoding": {"name": "default"}, "codecs": [{"name": "bytes"}, {"name": "gzip"}], "fill_value": -1, "dimension_names": ["time", "y", "x"], "attributes": meta}, f)
    for t in range(2):
        for i in range(3):
            for j in range(3):
                if (t, i, j) == (1, 2, 2):
                    continue  # a chunk that isn't stored
                block = np.full((1, 2, 3), -1, "<i4")
                part = cube[t : t + 1, 2 * i : 2 * i + 2, 3 * j : 3 * j + 3]
                block[:, : part.shape[1], : part.shape[2]] = part
                name = f"{t}.{i}.{j}" if version == 2 else f"c/{t}/{i}/{j}"
                os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
                with open(f"{d}/{name}", "wb") as f:
                    f.write(zlib.compress(block.tobytes()) if version == 2 else zlib.compress(block.tobytes(), wbits=31))
    l = arrays.read_zarr(spark, d, {"time": 1})
    got = {(r.y_index, r.x_index): r.value for r in l.df.collect()}
    want = {(y, x): cube[1, y, x] * 0.5 + 1 for y in range(5) for x in range(7) if cube[1, y, x] != -1 and (y, x) != (4, 6)}
    assert got == want and l.crs == "EPSG:3857"
    some = {(r.y_index, r.x_index): r.value for r in arrays.preview_zarr(spark, d, rows=9).df.collect()}
    assert some == {(y, x): cube[0, y, x] * 0.5 + 1 for y in (0, 2, 4) for x in (0, 2, 4, 6)}
    # Only the files of the chunks that the window touches are in the plan.
    part = arrays.read_zarr(spark, d, {"time": 1}, window=(2, 0, 2, 3))
    assert {f.rpartition(d)[2].strip("/") for f in part.df.inputFiles()} == {"1.1.0" if version == 2 else "c/1/1/0"}
    assert {(r.y_index, r.x_index) for r in part.df.collect()} == {(2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)}
    assert arrays.read_zarr(spark, d, {"time": 1}, skip_nodata=False).df.count() == 35
    some = arrays.read_zarr(spark, d, {"time": 0}, window=(1, 1, 4, 5), step=2, geometry="footprint", skip_nodata=False)
    assert sorted((r.y_index, r.x_index) for r in some.df.collect()) == [(y, x) for y in (1, 3) for x in (1, 3, 5)]
    r = some.df.where("y_index = 1 AND x_index = 1").withColumn("w", geo.st_area(F.col("geometry"))).first()
    assert (r.x, r.y, r.w) == (103.0, 47.0, 16.0)
    assert arrays.zarr_plan(arrays.array_meta(spark, d), {"time": 0}, (1, 1, 4, 5), 2) == {"rows": 6, "chunks": 6, "bytes": 144}
    with pytest.raises(ValueError):
        arrays.read_zarr(spark, d)


def workbook(path):
    sheet = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>0</v></c><c r="E3" t="s"><v>2</v></c></row>
<row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4"><v>2</v></c><c r="C4"><v>1.5</v></c><c r="D4" t="b"><v>1</v></c><c r="E4" s="1"><v>45000</v></c></row>
<row r="5"><c r="A5" t="s"><v>3</v></c><c r="B5"><v>3</v></c><c r="C5"><v>2</v></c><c r="E5" s="1"><v>45001</v></c></row></sheetData></worksheet>"""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="sites" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>count</t></si><si><t>when</t></si><si><r><t>Be</t></r><r><t>rn</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbooks(spark):
    d = tempfile.mkdtemp()
    workbook(f"{d}/a.xlsx")
    workbook(f"{d}/b.xlsx")
    l = tables.read_workbooks(spark, f"{d}/*.xlsx")
    assert l.df.dtypes == [("file", "string"), ("name", "string"), ("count", "bigint"), ("name_2", "double"), ("column_4", "boolean"), ("when", "date")]
    rows = l.df.drop("file").collect()
    assert len(rows) == 4 and tuple(map(str, rows[0])) == ("Bern", "2", "1.5", "True", "2023-03-15") and rows[1]["column_4"] is None


def test_geopackages(spark):
    d = tempfile.mkdtemp()
    point = struct.pack("<BIdd", 1, 1, 8.0, 47.0)
    for name in ("a", "b"):
        db = sqlite3.connect(f"{d}/{name}.gpkg")
        db.executescript("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER); INSERT INTO gpkg_spatial_ref_sys VALUES ('w', 4326, 'EPSG', 4326); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER); INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom', 4326); CREATE TABLE sites (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, v REAL);")
        db.execute("INSERT INTO sites VALUES (1, ?, 'x', 1.5), (2, NULL, NULL, NULL)", (tables.geopackage_geometry(point),))
        db.commit()
        db.close()
    l = tables.read_geopackage(spark, f"{d}/*.gpkg")
    assert l.geometry == "geom" and l.crs == "EPSG:4326" and l.df.dtypes == [("fid", "bigint"), ("geom", "binary"), ("name", "string"), ("v", "double")]
    got = sorted((r.fid, r.w or "", r.v or 0) for r in l.df.withColumn("w", geo.st_astext(F.col("geom"))).collect())
    assert got == [(1, "POINT (8 47)", 1.5)] * 2 + [(2, "", 0)] * 2
    with pytest.raises(ValueError):
        tables.read_geopackage(spark, f"{d}/*.gpkg", "none")


def test_default_zarr_plans():
    """A small array whole; a huge one by whole chunks in its middle, thinned out; a chunk over the budget by itself."""
    def meta(shape, chunks, dtype="<f4"):
        return arrays.ArrayMeta(shape, chunks, dtype, ("time", "y", "x")[-len(shape) :], None, ".", "", None, "C", {})

    small = arrays.default_plan(meta((3, 100, 200), (1, 50, 50)))
    assert small == {"pins": {"time": 0}, "window": (0, 0, 100, 200), "step": 1, "narrowed": False}
    huge = arrays.default_plan(meta((20, 528_000, 1_440_000), (20, 512, 512)), 200_000, 256 << 20)
    r0, c0, n, m = huge["window"]
    assert huge["narrowed"] and n == m == 3 * 512 and r0 % 512 == c0 % 512 == 0  # chunks of 20 MB: three by three
    assert abs(r0 + n / 2 - 264_000) <= 512 and abs(c0 + m / 2 - 720_000) <= 512
    assert huge["step"] == 4 and arrays.zarr_plan(meta((20, 528_000, 1_440_000), (20, 512, 512)), {"time": 0}, huge["window"], huge["step"])["rows"] <= 200_000
    one = arrays.default_plan(meta((4000, 4000), (4000, 4000)), 10**9, 1)
    assert one["window"] == (0, 0, 4000, 4000) and one["step"] == 1
    long = arrays.default_plan(meta((100, 10**7), (100, 100)), 0, 1 << 20)
    assert long["window"][0] == 0 and long["window"][2] == 100 and long["window"][3] == 500 and long["step"] == 1
