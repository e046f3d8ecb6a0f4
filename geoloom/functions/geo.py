"""Spatial column functions over WKB, run in the JVM by the geometry library that Spark ships.

The kernels are registered with a session when one of these functions is first used in it, so that the same names work
in SQL: ``register(spark)`` makes ``st_area`` and the others available there.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

JAR = Path(__file__).parent.parent / "jars" / "geoloom-kernels.jar"
_FACE = "array<struct<wkb:binary,certain:boolean,ids:array<bigint>,borders:array<struct<axis:int,at:double,above:boolean,lo:double,hi:double>>>>"
_VERTICES = "array<struct<x:double,y:double,z:double>>"
_KERNELS = {
    "Shape": "binary", "Measure": "double", "Compare": "double", "Combine": "binary", "Kind": "string", "AsText": "string", "FromText": "binary", "PointOf": "binary", "Box": "binary",
    "Bounds": "struct<minx:double,miny:double,maxx:double,maxy:double>", "Transform": "binary", "MetricBuffer": "binary", "Union": "binary", "Hull": "binary", "Polygons": "array<binary>",
    "AsGeoJson": "string", "FromGeoJson": "binary", "Vertices": _VERTICES, "FromVertices": "binary", "Faces": _FACE, "Clip": "array<binary>",
    "CellShape": "binary", "CellCentre": "binary", "CellFill": "array<struct<cell:bigint,whole:boolean,part:binary>>",
}
_TIFF = {
    "Head": "struct<width:int,height:int,bands:int,data_type:string,nodata:double,crs:string,transform:array<double>,bw:int,bh:int>", "Pixels": "array<double>", "Value": "double",
}
_ready: set[str] = set()

SHAPES = ("centroid", "point_on_surface", "convex_hull", "envelope", "min_rectangle", "min_circle", "boundary", "make_valid", "merge_lines", "exterior_ring")
SIZED = ("simplify", "buffer", "densify", "smooth")
MEASURES = {"area": "double", "length": "double", "perimeter": "double", "x": "double", "y": "double", "z": "double", "npoints": "int", "parts": "int", "holes": "int", "dimension": "int"}
TESTS = ("is_empty", "is_valid", "is_simple", "is_closed", "is_ring", "has_m")
RELATIONS = ("intersects", "contains", "within", "equals")


def register(spark: SparkSession | None = None) -> None:
    """Load the kernels into a session, and the ``st_`` functions of its SQL."""
    spark = spark or SparkSession.active()
    session = spark._jsparkSession.sessionUUID()
    if session in _ready:
        return
    spark.sql(f"ADD JAR '{JAR}'")
    for name, kind in _KERNELS.items():
        spark.udf.registerJavaFunction(f"geo_{name.lower()}", f"geoloom.Udfs${name}", kind)
    for name, kind in _TIFF.items():
        spark.udf.registerJavaFunction(f"geo_tiff{name.lower()}", f"geoloom.Tiff${name}", kind)
    spark.udf.registerJavaFunction("geo_footer", "geoloom.Footer", "long")
    for name in ("Union", "Extent", "Hull"):
        spark.udf.registerJavaUDAF(f"st_{name.lower()}_agg", f"geoloom.Aggregates${name}Agg")
    text = [(f"st_{n}", "g BINARY", "BINARY", f"geo_shape('{n}', g, 0D)") for n in SHAPES]
    text += [(f"st_{n}", "g BINARY, a DOUBLE", "BINARY", f"geo_shape('{n}', g, a)") for n in SIZED]
    text += [(f"st_{n}", "g BINARY", k, f"CAST(geo_measure('{n}', g) AS {k})") for n, k in MEASURES.items()]
    text += [(f"st_{n.replace('_', '')}", "g BINARY", "BOOLEAN", f"geo_measure('{n}', g) = 1") for n in TESTS]
    text += [(f"st_{n}", "a BINARY, b BINARY", "BOOLEAN", f"geo_compare('{n}', a, b) = 1") for n in RELATIONS]
    text += [("st_distance", "a BINARY, b BINARY", "DOUBLE", "geo_compare('distance', a, b)"), ("st_dwithin", "a BINARY, b BINARY, d DOUBLE", "BOOLEAN", "geo_compare('distance', a, b) <= d")]
    text += [("st_intersection", "a BINARY, b BINARY", "BINARY", "geo_combine('intersection', a, b)"), ("st_difference", "a BINARY, b BINARY", "BINARY", "geo_combine('difference', a, b)")]
    text += [("st_point", "x DOUBLE, y DOUBLE", "BINARY", "geo_pointof(x, y, CAST(NULL AS DOUBLE))"), ("st_makeenvelope", "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "BINARY", "geo_box(a, b, c, d)")]
    text += [("st_geomfromtext", "t STRING", "BINARY", "geo_fromtext(t)"), ("st_astext", "g BINARY", "STRING", "geo_astext(g)"), ("st_geometrytype", "g BINARY", "STRING", "geo_kind(g)")]
    text += [("st_transform", "g BINARY, a STRING, b STRING", "BINARY", "geo_transform(g, a, b)"), *[(f"st_{n}", "g BINARY", "DOUBLE", f"geo_bounds(g).{f}") for n, f in (("xmin", "minx"), ("ymin", "miny"), ("xmax", "maxx"), ("ymax", "maxy"))]]
    # The spellings that spatial SQL dialects share.
    text += [(f"st_{n.replace('_', '')}", "g BINARY", "BINARY", f"geo_shape('{n}', g, 0D)") for n in SHAPES if "_" in n]
    text += [("st_simplifypreservetopology", "g BINARY, a DOUBLE", "BINARY", "geo_shape('simplify', g, a)"), ("st_linemerge", "g BINARY", "BINARY", "geo_shape('merge_lines', g, 0D)")]
    text += [(n, "g BINARY", "INT", f"CAST(geo_measure('{m}', g) AS INT)") for n, m in (("st_numgeometries", "parts"), ("st_ninteriorrings", "holes"), ("st_numinteriorrings", "holes"))]
    text += [("st_convex", "g BINARY", "BOOLEAN", "geo_measure('is_convex', g) = 1")]
    text += [("st_aswkb", "g BINARY", "BINARY", "g"), ("st_geomfromhexwkb", "t STRING", "BINARY", "unhex(t)"), ("st_asgeojson", "g BINARY", "STRING", "geo_asgeojson(g)")]
    text += [("st_hasz", "g BINARY", "BOOLEAN", "exists(geo_vertices(g), v -> v.z IS NOT NULL)"), ("st_pointn", "g BINARY, n INT", "BINARY", "geo_pointof(get(geo_vertices(g), n - 1).x, get(geo_vertices(g), n - 1).y, get(geo_vertices(g), n - 1).z)")]
    text += [("st_unionarray", "a ARRAY<BINARY>", "BINARY", "geo_union(a)"), ("st_hullarray", "a ARRAY<BINARY>", "BINARY", "geo_hull(a)"), ("st_dump", "g BINARY", "ARRAY<BINARY>", "geo_polygons(g)")]
    text += [("h3_cell_to_boundary", "c BIGINT", "BINARY", "geo_cellshape(c)"), ("h3_cell_to_centre", "c BIGINT", "BINARY", "geo_cellcentre(c)"), ("h3_get_resolution", "c BIGINT", "INT", "CAST((c >> 52) & 15 AS INT)")]
    for name, args, kind, body in text:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    _ready.add(session)


def _call(name: str, *args) -> Column:
    register()
    return F.call_function(f"geo_{name}", *[a if isinstance(a, Column) else F.lit(a) for a in args])


def st_shape(op: str, g: Column, a: float = 0.0) -> Column:
    return _call("shape", op, g, F.lit(float(a)))


def st_measure(op: str, g: Column) -> Column:
    return _call("measure", op, g)


def st_centroid(g: Column) -> Column:
    return st_shape("centroid", g)


def st_area(g: Column) -> Column:
    return st_measure("area", g)


def st_x(g: Column) -> Column:
    return st_measure("x", g)


def st_y(g: Column) -> Column:
    return st_measure("y", g)


def st_point(x: Column, y: Column, z: Column | None = None) -> Column:
    return _call("pointof", x.cast("double"), y.cast("double"), F.lit(None).cast("double") if z is None else z.cast("double"))


def st_box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return _call("box", *[c.cast("double") for c in (minx, miny, maxx, maxy)])


def st_bounds(g: Column) -> Column:
    return _call("bounds", g)


def st_intersects(a: Column, b: Column) -> Column:
    return _call("compare", "intersects", a, b) == 1


def st_distance(a: Column, b: Column) -> Column:
    return _call("compare", "distance", a, b)


def st_intersection(a: Column, b: Column) -> Column:
    return _call("combine", "intersection", a, b)


def st_union(shapes: Column) -> Column:
    """The union of an array of shapes; nulls are left out, none gives null."""
    return _call("union", shapes)


def st_hull(shapes: Column) -> Column:
    """The convex hull of an array of shapes."""
    return _call("hull", shapes)


def st_hull_agg(g: Column) -> Column:
    """The convex hull of a group's shapes, of which no more than the hull so far is kept."""
    register()
    return F.call_function("st_hull_agg", g)


def st_transform(g: Column, source: str, target: str) -> Column:
    return g if source == target else _call("transform", g, source, target)


def st_geometrytype(g: Column) -> Column:
    """The type's name in capitals."""
    return F.upper(_call("kind", g))


def st_astext(g: Column) -> Column:
    return _call("astext", g)


def st_asgeojson(g: Column) -> Column:
    return _call("asgeojson", g)


def st_geomfromgeojson(kind: Column, coordinates: Column) -> Column:
    """From a GeoJSON geometry's type and the JSON text of its coordinates."""
    return _call("fromgeojson", kind, coordinates)


def st_geomfromtext(t: Column) -> Column:
    return _call("fromtext", t)


def st_polygons(g: Column) -> Column:
    return _call("polygons", g)


def st_buffer_metric(g: Column, distance: float, mode: str) -> Column:
    return _call("metricbuffer", g, F.lit(float(distance)), mode)


def st_vertices(g: Column) -> Column:
    return _call("vertices", g)


def st_from_vertices(vertices: Column, polygon: Column) -> Column:
    return _call("fromvertices", vertices, polygon)


def st_faces(parts: Column, box: Column, tau: Column) -> Column:
    """The faces of the polygons of one tile; ``box`` (minx, miny, maxx, maxy) is null where there is only one."""
    return _call("faces", parts, box, tau)


def st_clip(g: Column, box: Column) -> Column:
    """The polygons that a box (minx, miny, maxx, maxy) cuts from a polygon."""
    return _call("clip", g, box)


def cell_shape(cell: Column) -> Column:
    """A grid cell's polygon by its number; null for what isn't a cell."""
    return _call("cellshape", cell)


def cell_centre(cell: Column) -> Column:
    """A grid cell's centre as a point; null for what isn't a cell."""
    return _call("cellcentre", cell)


def cell_fill(polygon: Column, cell: Column, resolution: int, rule: str) -> Column:
    """From a cell, or all base cells where it is null, some way down to those at a resolution that count for a polygon."""
    return _call("cellfill", polygon, cell, F.lit(resolution), rule)


def tiff_head(path: Column) -> Column:
    """What a GeoTIFF's tags say; only they are read."""
    return _call("tiffhead", path)


def tiff_pixels(path: Column, band: Column, bx: Column, by: Column) -> Column:
    """A block's values of a band, row by row; only the block is read."""
    return _call("tiffpixels", path, band, bx, by)


def tiff_value(path: Column, band: Column, column: Column, row: Column) -> Column:
    """A pixel's value; a task keeps the blocks that it has just read, so that rows should come block by block."""
    return _call("tiffvalue", path, band, column, row)
