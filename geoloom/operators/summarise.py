"""Aggregates, statistics and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions import geo
from geoloom.functions.values import col
from geoloom.layer import Layer, layer, need_columns, need_geometry

#: Shapes that are united at a time.
STACK = 1000
AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count distinct": F.count_distinct}


def aggregate(l: Layer, group_by: Sequence[str] = (), aggregates: Sequence[tuple[str, str | None, str | None]] = (), geometry: str = "Drop") -> Layer:
    """One row for each group, or one row in all, also for no input.

    ``aggregates`` are (function, column, name); a missing column of ``count`` counts rows, a missing name is made of
    both. Without any, ``count`` of rows. ``geometry="Dissolve"`` adds the union of each group's shapes.
    """
    need_columns(l.df, [*group_by, *[c for _, c, _ in aggregates if c]])
    out = []
    for func, column, name in aggregates:
        if func not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {func}")
        name = name or f"{func.replace(' ', '_')}_{column or 'all'}"
        out.append((F.count(F.lit(1)) if not column else AGGREGATES[func](col(column))).alias(name))
    out = out or [F.count(F.lit(1)).alias("count")]
    df = l.df.groupBy(*map(col, group_by)).agg(*out)
    if geometry != "Dissolve":
        return layer(df, crs=l.crs)
    shapes = dissolve(l, group_by).df.drop("parts")
    if not group_by:
        return layer(df.crossJoin(F.broadcast(shapes)), l.geometry, l.crs)  # one row by one row
    same = [df[quoted(c)].eqNullSafe(shapes[quoted(c)]) for c in group_by]
    joined = df.join(shapes, same).select(*[df[quoted(c)] for c in df.columns], shapes[quoted(l.geometry)])
    return layer(joined, l.geometry, l.crs)


def order_statistics(l: Layer, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """``group_by``, and of a numeric column ``_count``, ``_median`` and ``_mode``, exactly, for groups of any size.

    No group is held in one place, as the aggregates of the same names hold their distinct values: equal values of a group are
    counted as one, all are put in order by group and value over many tasks, and running counts, of which only the tasks' sums
    meet, tell every value's ranks. The median is the mean of the two middle ranks, the mode the most frequent value, of
    equally frequent ones the least. Nulls and no numbers are left out; a group without a number has a count of 0 and nulls.
    Without ``group_by`` all rows are one group, and no rows give no group.
    """
    need_columns(l.df, [column, *group_by])
    by = [f"_g{k}" for k in range(len(group_by))] or ["_g0"]
    rows = l.df.select(*([col(c).alias(b) for c, b in zip(group_by, by, strict=False)] or [F.lit(0).alias("_g0")]), col(column).cast("double").alias("_v"))
    cells = written(rows.groupBy(*by, F.when(~F.isnan("_v"), F.col("_v")).alias("_v")).agg(F.count("_v").alias("_n")), "cells")
    found = cells.where("_v IS NOT NULL")
    # Rows in order, numbered by part and place; each part's window is one task's share.
    order = written(found.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v").withColumn("_m", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_m", 33)
    sums = order.groupBy(part.alias("_p")).agg(F.sum("_n").alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    ranks = order.withColumn("_p", part).withColumn("_inside", upto).join(F.broadcast(sums), "_p").select(*by, "_v", "_n", (F.col("_before") + F.col("_inside")).alias("_last"))
    ranks = written(ranks, "ranks")
    # A group's ranks begin after the last of the group before it.
    groups = ranks.groupBy(*by).agg(F.sum("_n").alias("_count"), (F.max("_last") - F.sum("_n")).alias("_start"), F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias("_mode"))
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"g.{b}")) for b in by]
    place = lambda up: F.col("g._start") + F.floor((F.col("g._count") + up) / 2)
    holds = lambda r: (F.col("r._last") >= r) & (F.col("r._last") - F.col("r._n") < r)
    middle = ranks.alias("r").join(groups.alias("g"), same).where(holds(place(1)) | holds(place(2)))
    # Both middle ranks are in one cell, or in two.
    middle = middle.groupBy(*[F.col(f"g.{b}").alias(b) for b in by]).agg(F.avg("r._v").alias("_median"))
    out = cells.select(*by).distinct().alias("a")
    for k, (side, name) in enumerate(((groups, "_count"), (middle, "_median"))):
        other = side.select(*[F.col(b).alias(f"{b}_{k}") for b in by], *(["_count", "_mode"] if name == "_count" else ["_median"]))
        out = out.join(other, [F.col(b).eqNullSafe(F.col(f"{b}_{k}")) for b in by], "left").drop(*[f"{b}_{k}" for b in by])
    names = [F.col(b).alias(c) for c, b in zip(group_by, by, strict=False)]
    return out.select(*names, F.coalesce("_count", F.lit(0)).alias(f"{column}_count"), F.col("_median").alias(f"{column}_median"), F.col("_mode").alias(f"{column}_mode"))


def quoted(name: str) -> str:
    return f"`{name}`"


def dissolve(l: Layer, group_by: Sequence[str] = ()) -> Layer:
    """The union of each group's shapes, and ``parts``, the rows it is made of.

    Equal shapes are first made one. The others of a group are united in stacks of about ``STACK`` neighbours, those
    unions again, and so on, so that no task holds more than a stack, however large a group or crowded a place is; the
    last union, the result itself, is one value.
    """
    g = need_geometry(l)
    need_columns(l.df, list(group_by))
    names = [f"_k{i}" for i in range(len(group_by))]
    keys = names or ["_k"]
    df = l.df.select(*[col(c).alias(n) for c, n in zip(group_by, names, strict=True)] or [F.lit(0).alias("_k")], col(g).alias("_g"))
    df = df.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    # Neighbours first: a stack is a run along a curve through the plane.
    b = geo.st_bounds(F.col("_g"))
    df = written(df.withColumn("_at", _along_curve(b["minx"], b["miny"])), "dissolve")
    most = _largest(df, keys)
    while most > STACK:
        spans = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / STACK).alias("_runs"), F.min("_at").alias("_lo"), (F.max("_at") - F.min("_at") + 1).alias("_wide"))
        df = _matched(df, spans, keys).withColumn("_run", F.floor((F.col("_at") - F.col("_lo")) / F.col("_wide") * F.col("_runs"))).drop("_runs", "_lo", "_wide")
        # A crowded run is dealt into several stacks.
        crowds = df.groupBy(*keys, "_run").agg(F.ceil(F.count(F.lit(1)) / STACK).alias("_stacks"))
        df = _matched(df, crowds, [*keys, "_run"]).withColumn("_deal", F.pmod(F.xxhash64("_g"), F.col("_stacks")))
        df = df.groupBy(*keys, "_run", "_deal").agg(geo.st_union(F.collect_list("_g")).alias("_g"), F.sum("_n").alias("_n"), F.min("_at").alias("_at")).drop("_run", "_deal")
        df = written(df, "dissolve")
        most = _largest(df, keys)
    df = df.groupBy(*names).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("parts"), geo.st_union(F.collect_list("_g")).alias(g))
    return layer(df.select(*[F.col(n).alias(c) for c, n in zip(group_by, names, strict=True)], "parts", g), g, l.crs)


def _largest(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _matched(rows: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each of their keys; null keys match."""
    on = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return rows.alias("r").join(one.alias("o"), on).select("r.*", *[f"o.{c}" for c in one.columns if c not in keys])


def _along_curve(x: Column, y: Column) -> Column:
    """A place along a curve of squares (Z order) through 65,536 columns and rows of the range that coordinates have."""
    cell = lambda c: F.floor((F.signum(c) * F.log1p(F.abs(c)) / 40 + 0.5) * 65_536).cast("long")

    def spread(c: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    return F.coalesce(spread(cell(x)).bitwiseOR(F.shiftleft(spread(cell(y)), 1)), F.lit(0)).cast("double")


#: Statistic to expression; the names are those of the report.
STATISTICS = {
    "Minimum": lambda c: F.min(c),
    "Maximum": lambda c: F.max(c),
    "Sum": lambda c: F.sum(c),
    "Mean": lambda c: F.avg(c),
    "Median": lambda c: F.median(c),
    "Range": lambda c: F.max(c) - F.min(c),
    "Standard deviation": lambda c: F.stddev_samp(c),
    "Standard deviation (population)": lambda c: F.stddev_pop(c),
    "Mode": lambda c: F.mode(c, True),
    "Total count": lambda c: F.count(F.lit(1)),
    "Numeric count": lambda c: F.count(c),
    "Value count": lambda c: F.count_distinct(c),
}


def statistics(l: Layer, group_by: Sequence[str] = (), attributes: Sequence[str] = (), stats: Sequence[str] = ("Minimum", "Maximum", "Mean", "Total count")) -> dict[str, Layer]:
    """``summary``, a row for each group, and ``complete``, every row with its group's statistics.

    Columns are ``attribute_statistic`` in lower case with underscores; without attributes, ``count``. The range is the
    group's maximum less its minimum on both ports. Groups are aggregated once and joined back, so that a group of any
    size needs no window; null group values are a group.
    """
    need_columns(l.df, [*group_by, *attributes])
    wanted = [(a, s) for a in attributes for s in stats]
    exprs = [STATISTICS[s](col(a)).alias(f"{a}_{s}".lower().replace(" ", "_")) for a, s in wanted] or [F.count(F.lit(1)).alias("count")]
    summary = l.df.groupBy(*map(col, group_by)).agg(*exprs)
    new = [c for c in summary.columns if c not in group_by]
    if not group_by:
        complete = l.df.crossJoin(F.broadcast(summary))  # by one row
    else:
        s = summary.select(*[col(c).alias(f"_k{k}") for k, c in enumerate(group_by)], *map(col, new))
        on = [col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(group_by)]
        complete = l.df.join(s, on).select(*map(col, l.columns), *map(col, new))
    return {"summary": layer(summary, crs=l.crs), "complete": l.with_df(complete)}


def correlation(l: Layer, columns: Sequence[str]) -> Layer:
    """``a, b, r, n``: Pearson's r for each pair of columns, the strongest first, undefined ones last.

    All pairs come from one pass. A pair counts the rows in which both are known; ``n`` is all rows. Exactly constant
    columns have no correlation.
    """
    columns = list(dict.fromkeys(columns))
    if len(columns) < 2:
        raise ValueError("at least two attributes are needed")
    need_columns(l.df, columns)
    pairs = list(combinations(columns, 2))
    both = lambda a, b: [F.when(col(b).isNotNull(), col(a)).cast("double"), F.when(col(a).isNotNull(), col(b)).cast("double")]

    def r(a: str, b: str) -> Column:
        x, y = both(a, b)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = l.df.agg(F.count(F.lit(1)).alias("n"), *[r(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    out = one.select("n", F.explode(rows).alias("p")).select("p.a", "p.b", "p.r", "n")
    return layer(out.orderBy(F.abs("r").desc_nulls_last(), "a", "b"), crs=l.crs)


def histogram(l: Layer, column: str, bins: int = 20) -> Layer:
    """``bin, bin_start, bin_end, n`` of the bins that hold values, in order; the maximum is in the last bin."""
    if not column:
        raise ValueError("an attribute is needed")
    need_columns(l.df, [column])
    bins = max(1, round(bins))
    v = l.df.select(col(column).cast("double").alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    bin = F.when(F.col("width") == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("width"))).cast("int")))
    # The ends are one row: every row of the input meets it without a shuffle.
    out = v.crossJoin(F.broadcast(ends)).groupBy(bin.alias("bin"), "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    out = out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "n")
    return layer(out.orderBy("bin"), crs=l.crs)


def unique_values(l: Layer, column: str) -> Layer:
    """``value, n, percent``: how often each value occurs, null too, the commonest first."""
    if not column:
        raise ValueError("an attribute is needed")
    need_columns(l.df, [column])
    counts = l.df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = l.df.agg(F.count(F.lit(1)).alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("_total")), 2).alias("percent"))
    return layer(out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()), crs=l.crs)


def windowed(c: Column, group_by: Sequence[str]) -> Column:
    """An aggregate over the rows of a group, for those who want a column and no join."""
    return c.over(Window.partitionBy(*map(col, group_by)))
