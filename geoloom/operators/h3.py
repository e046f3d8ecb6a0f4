"""Cells of the hexagonal grid: by bit arithmetic resolution, parents, cells by position, roll-up; cells as shapes, shapes as cells.

A cell's number has the resolution in bits 52 to 55, the base cell in 45 to 51, and fifteen digits of three bits, the
coarsest first; digits below the resolution are 7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import LON_LAT, Layer, is_lon_lat, need_columns, need_geometry, numeric_columns

DIGITS = 15
#: Which cells count for a polygon; fixed names.
RULES = ("ContainsCentroid", "ContainsBoundary", "Covers", "CoversBoundingBox")
#: A step of a fill from an open cell goes at least so many levels down.
LEVELS_A_STEP = 3


def cell_number(c: Column) -> Column:
    """A cell's number from its text (hexadecimal, any case) or a number."""
    return F.conv(F.lower(c.cast("string")), 16, -10).cast("long")


def cell_text(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 15, "0")


def h3_resolution(n: Column) -> Column:
    return F.shiftright(n, 52).bitwiseAND(F.lit(15)).cast("int")


def h3_parent(n: Column, resolution: int) -> Column:
    """The cell at a coarser resolution that holds this one; itself at its own, null at a finer."""
    digits = F.lit((1 << (3 * (DIGITS - resolution))) - 1).cast("long")
    kept = n.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit(resolution << 52).cast("long"))
    return F.when(h3_resolution(n) >= resolution, kept.bitwiseOR(digits))


def h3_child(parent: int, resolution: int, position: Column) -> Column:
    """The ``position``-th descendant of a cell at a resolution: the position's base-7 digits become the cell's."""
    start = (parent >> 52) & 15
    if not start <= resolution <= DIGITS:
        raise ValueError("the resolution must not be coarser than the parent's")
    base = (parent & ~(15 << 52)) | (resolution << 52)
    for d in range(start + 1, resolution + 1):
        base &= ~(7 << (3 * (DIGITS - d)))
    out = F.lit(base).cast("long")
    for k, d in enumerate(range(resolution, start, -1)):
        digit = F.call_function("div", position, F.lit(7**k)) % 7
        out = out.bitwiseOR(F.shiftleft(digit.cast("long"), 3 * (DIGITS - d)))
    return out


def positional(l: Layer, parent: str, resolution: int | None = None, row_number: str = "file_row_number", index: str = "h3_index", rows: int | None = None) -> Layer:
    """Replace the row number by the cell at that place below ``parent``, as text of 15 digits.

    Without ``resolution`` it follows from ``rows``, which must be a power of seven.
    """
    if not is_lon_lat(l.crs):
        raise ValueError("cells need a lon/lat layer")
    need_columns(l.df, [row_number])
    p = int(parent, 16)
    if resolution is None:
        k = next((k for k in range(DIGITS + 1) if 7**k == rows), None)
        if k is None:
            raise ValueError("the rows don't fill a parent cell: their number is no power of seven")
        resolution = ((p >> 52) & 15) + k
    c = cell_text(h3_child(p, resolution, col(row_number).cast("long")))
    return l.with_df(l.df.select(*[c.alias(index) if n == row_number else col(n) for n in l.columns]))


def rollup(df: DataFrame, cell: str, resolution: int) -> DataFrame:
    """``parent, cells`` and the mean of every numeric column for each parent; ``cell`` is a number or text."""
    need_columns(df, [cell])
    means = [c for c in numeric_columns(df) if c != cell]
    n = col(cell) if dict(df.dtypes)[cell] == "bigint" else cell_number(col(cell))
    return df.groupBy(h3_parent(n, resolution).alias("parent")).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(col(c)).alias(c) for c in means])


def cell_shapes(l: Layer, index: str = "h3_index", geometry: str = "geometry", every: int = 1) -> Layer:
    """Add each row's cell as a polygon, in the last column; rows without a cell number are dropped.

    ``index`` is a number or text. With ``every`` only one cell in so many stays, by a hash of the number, so that the rows of
    a cell stay or go together. What isn't a cell has a null shape. The result is lon/lat.
    """
    need_columns(l.df, [index])
    if every < 1:
        raise ValueError("every must be at least 1")
    n = col(index) if dict(l.df.dtypes)[index] == "bigint" else cell_number(col(index))
    df = l.df.where(col(index).isNotNull())
    if every > 1:
        df = df.where(F.pmod(F.xxhash64(n), F.lit(every)) == 0)
    rest = [col(c) for c in l.columns if c != geometry]
    return Layer(df.select(*rest, geo.cell_shape(n).alias(geometry)), geometry, LON_LAT)


def position_shapes(l: Layer, parent: str, resolution: int | None = None, row_number: str = "file_row_number", index: str = "h3_index", rows: int | None = None, geometry: str = "geometry", every: int = 1) -> Layer:
    """``positional`` and ``cell_shapes`` in one: rows of a dense tile with their cells' numbers, last, and polygons.

    With ``every`` rows are sampled by their number.
    """
    need_columns(l.df, [row_number])
    if every < 1:
        raise ValueError("every must be at least 1")
    some = l.with_df(l.df.where(col(row_number) % every == 0)) if every > 1 else l
    numbered = positional(some, parent, resolution, row_number, index, rows)
    last = [c for c in numbered.columns if c not in (index, geometry)]
    return cell_shapes(numbered.with_df(numbered.df.select(*map(col, last), col(index))), index, geometry)


def descendants(cell: Column, resolution: int) -> Column:
    """The numbers of all cells at a resolution below a cell that is no pentagon, as an array in rising order."""
    depth = F.lit(resolution) - h3_resolution(cell)
    levels = range(DIGITS)
    free = cell.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit(resolution << 52).cast("long"))
    shift = 3 * (DIGITS - resolution)

    def placed(i: Column) -> Column:
        # The position's base-7 digits, as many as there are levels between, in place of the digits 7.
        out = free
        for k in levels:
            if resolution - k < 1:
                break
            digit = F.call_function("div", i, F.lit(7**k)) % 7
            own = F.lit(7 << (shift + 3 * k)).cast("long")
            out = F.when(depth > k, out.bitwiseAND(F.bitwise_not(own)).bitwiseOR(F.shiftleft(digit.cast("long"), shift + 3 * k))).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(7), depth).cast("long") - 1), placed)


def polygon_cells(l: Layer, resolution: int = 7, rule: str = "ContainsCentroid", index: str = "h3_index", shapes: bool = True, partitions: int | None = None) -> Layer:
    """One row for each polygon and cell that counts for it: the other columns, the cell's number, and its shape if wanted.

    A cell counts if its centre is inside the polygon, if it lies wholly inside, if it overlaps it, or if its bounding box
    (a little enlarged) does. A polygon goes to the coarsest cells first; those apart from it are dropped, those inside it
    come down as a whole, and only those on its outline are opened further. Open cells are dealt anew to all tasks after
    the first step, each with its part of a large polygon, so that one polygon is filled by many tasks. The parts of a
    multi-polygon count each by itself; other shapes, empty ones and nulls have no cells. A polygon is taken as drawn on
    the plane of longitudes and latitudes.
    """
    g = need_geometry(l)
    if not is_lon_lat(l.crs):
        raise ValueError("cells need a longitude/latitude layer")
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}; known are {', '.join(RULES)}")
    if not 0 <= resolution <= DIGITS:
        raise ValueError("a resolution is between 0 and 15")
    rest = [c for c in l.columns if c not in (g, index)]
    row = l.df.select(F.struct(*map(col, rest)).alias("row") if rest else F.lit(0).alias("row"), col(g).alias("polygon"))
    # Polygons come to tasks by where they are, however few files they are read from; a crowded place is divided.
    b = geo.st_bounds(F.col("polygon"))
    place = [F.floor(b["minx"]), F.floor(b["miny"]), F.xxhash64("polygon")]
    row = row.repartitionByRange(*([partitions] if partitions else []), *place).sortWithinPartitions(*place)
    found = row.select("row", "polygon", F.explode(geo.cell_fill(F.col("polygon"), F.lit(None).cast("long"), resolution, rule)).alias("at"))
    # The first step may end anywhere above; from there each goes some levels further.
    for step in range(-(-resolution // LEVELS_A_STEP)):
        # What is decided needs its polygon no more.
        found = found.select("row", F.when(~F.col("at.whole"), F.coalesce("at.part", "polygon")).alias("polygon"), "at")
        if not step:
            found = found.repartition(*([partitions] if partitions else []), F.col("at.cell"), F.xxhash64("polygon"))
        more = geo.cell_fill(F.col("polygon"), F.col("at.cell"), resolution, rule)
        found = found.select("row", "polygon", F.explode(F.when(F.col("at.whole"), F.array("at")).otherwise(more)).alias("at"))
    cells = found.select("row", F.explode(descendants(F.col("at.cell"), resolution)).alias("cell"))
    own = [F.col("row").getField(c).alias(c) for c in rest]
    if not shapes:
        return Layer(cells.select(*own, cell_text(F.col("cell")).alias(index)), None, l.crs)
    return Layer(cells.select(*own, cell_text(F.col("cell")).alias(index), geo.cell_shape(F.col("cell")).alias(g)), g, l.crs)
