"""Profiles of a layer's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, NumericType, StringType, StructType

from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, need_columns

TOP, CATEGORY_ROWS, CATEGORIES, SUGGESTIONS = 5, 20_000, 25, 50
SAMPLE_ROWS, SAMPLE_CHARS = 20, 80
#: Parts of a column's values among which the commonest are looked for.
PARTS = 64


def _opaque(kind: DataType) -> bool:
    return isinstance(kind, BinaryType | ArrayType | MapType | StructType)


def profile(l: Layer) -> DataFrame:
    """``column, null_share, distinct, min, max, top, extent`` of each column; values as text, numbers ordered as numbers.

    One pass makes shares, bounds and the geometry's extent (least x and y, greatest x and y), a second one the counts
    by value, from which ``distinct`` and ``top``, the five commonest values (ties by value), follow. Columns of bytes,
    lists and structs have only a share of nulls.
    """
    kinds = {f.name: f.dataType for f in l.df.schema}
    plain = [c for c in l.columns if c != l.geometry and not _opaque(kinds[c])]
    aggs, nothing = [], {"min": F.lit(None).cast("string"), "max": F.lit(None).cast("string"), "extent": F.lit(None).cast("array<double>")}
    for c in l.columns:
        own = dict(nothing)
        if c in plain:
            own |= {"min": F.min(col(c)).cast("string"), "max": F.max(col(c)).cast("string")}
        elif c == l.geometry:
            b = geo.st_bounds(col(c))
            own["extent"] = F.when(F.count(b["minx"]) > 0, F.array(F.min(b["minx"]), F.min(b["miny"]), F.max(b["maxx"]), F.max(b["maxy"])))
        share = F.coalesce(F.lit(1.0) - F.try_divide(F.count(col(c)).cast("double"), F.count(F.lit(1))), F.lit(0.0))
        aggs.append(F.struct(F.lit(c).alias("column"), share.alias("null_share"), *[v.alias(n) for n, v in own.items()]))
    stats = l.df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    if not plain:
        return stats.select("column", "null_share", F.lit(None).cast("long").alias("distinct"), "min", "max", F.lit(None).cast("array<string>").alias("top"), "extent")
    cells = l.df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in plain])).alias("c")).select("c.*")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    # A column may have very many values: the commonest are found among those of parts first.
    order = [F.col("k").desc(), "value"]
    parts = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(PARTS))).orderBy(*order)
    best = counts.where("value IS NOT NULL").withColumn("i", F.row_number().over(parts)).where(F.col("i") <= TOP)
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("i") <= TOP)
    tops = best.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("top"))
    values = counts.groupBy("column").agg(F.count("value").alias("distinct")).join(tops, "column", "left")
    out = stats.join(values, "column", "left")
    empty = F.when(F.col("column").isin(plain), F.coalesce("distinct", F.lit(0)))
    return out.select("column", "null_share", empty.cast("long").alias("distinct"), "min", "max", F.when(F.col("column").isin(plain), F.coalesce("top", F.array().cast("array<string>"))).alias("top"), "extent")


def categories(l: Layer, column: str, rows: int | None = CATEGORY_ROWS, k: int = CATEGORIES) -> DataFrame:
    """``value, n`` over the first ``rows`` rows, or all; empty if there are more than ``k`` values: not a category."""
    need_columns(l.df, [column])
    some = l.df if rows is None else l.df.limit(rows)
    counts = some.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(k + 1)
    return top.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("_all") <= k).drop("_all")


def sample(l: Layer, rows: int = SAMPLE_ROWS, order: Sequence[str] = (), chars: int = SAMPLE_CHARS) -> DataFrame:
    """The first ``rows`` rows, by ``order`` if it is given, as a reader would look at them.

    The geometry is WKT, other bytes are ``(binary)``, and every text is cut after ``chars`` characters.
    """
    need_columns(l.df, list(order))
    first = (l.df.orderBy(*map(col, order)) if order else l.df).limit(rows)
    cut = lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)
    shown = []
    for f in l.df.schema:
        c = col(f.name)
        if f.name == l.geometry:
            c = cut(geo.st_astext(c))
        elif isinstance(f.dataType, BinaryType):
            c = F.when(c.isNotNull(), F.lit("(binary)"))
        elif isinstance(f.dataType, StringType):
            c = cut(c)
        shown.append(c.alias(f.name))
    return first.select(*shown)


def suggestions(l: Layer, column: str) -> DataFrame:
    """``value, n``: minimum, quartiles and maximum of numbers; of others the 50 commonest values."""
    need_columns(l.df, [column])
    if isinstance(l.df.schema[column].dataType, NumericType):
        c = col(column)
        five = l.df.agg(F.array(F.min(c).cast("double"), *[F.percentile(c, q) for q in (0.25, 0.5, 0.75)], F.max(c).cast("double")).alias("v"))
        return five.select(F.posexplode("v").alias("n", "value")).select(F.col("value").cast("string").alias("value"), F.col("n").cast("long").alias("n"))
    counts = l.df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(SUGGESTIONS)
