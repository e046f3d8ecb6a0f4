"""Sorting, sampling and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.functions.values import col
from geoloom.layer import Layer, need_columns

PREVIEW = 100_000


def sort(l: Layer, sorts: Sequence[tuple[str, str]]) -> Layer:
    """By several keys, each ``ASC`` or ``DESC``; nulls last either way; without keys as it is."""
    keys = [(c, d) for c, d in sorts if c]
    need_columns(l.df, [c for c, _ in keys])
    if not keys:
        return l
    return l.with_df(l.df.orderBy(*[col(c).desc_nulls_last() if d.upper() == "DESC" else col(c).asc_nulls_last() for c, d in keys]))


def sample(l: Layer, mode: str = "First N", amount: float = 1000, order: Sequence[Column | str] | None = None, seed: int | None = None) -> Layer:
    """``First N`` rows, ``Every Nth`` row (N, 2N, ...) or ``Random %``; an amount that isn't above 0 keeps all.

    ``order`` gives the rows an order to count in; without it the order of the files is used.
    """
    try:
        amount = float(amount)
    except (TypeError, ValueError):
        return l
    if not amount > 0:
        return l
    if mode == "First N":
        return l.with_df((l.df.orderBy(*order) if order else l.df).limit(round(amount)))
    if mode == "Random %":
        return l.with_df(l.df.sample(fraction=min(100.0, amount) / 100, seed=seed))
    step = max(1, round(amount))
    return l.with_df(numbered(l.df, "_n", order).where(F.col("_n") % step == 0).drop("_n"))


def numbered(df: DataFrame, to: str, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Number the rows from 1 in order, without ever bringing all of them into one task.

    The rows are range-partitioned by ``order`` (else kept where they are), written, counted by part, and numbered
    within the parts; only the parts' counts are summed up in one place.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = written(parted.select("*", F.monotonically_increasing_id().alias("_m")), "numbered")
    part = F.shiftright("_m", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_m") - F.shiftleft(part, 33)
    out = rows.withColumn("_p", part).join(F.broadcast(counts), "_p")
    return out.select(*map(col, df.columns), (inside + F.col("_before") + 1).alias(to))


def preview_count(l: Layer, cap: int = PREVIEW) -> int:
    """How many rows, but no more than one above ``cap`` are counted."""
    return l.df.limit(cap + 1).count()


def sampled_cells(df: DataFrame, cell: str, step: int) -> DataFrame:
    """About one of ``step`` cells, the same ones whatever the partitioning."""
    return df.where(F.pmod(F.xxhash64(col(cell)), F.lit(step)) == 0)


def cell_step(rows: int, wanted: int = 50_000) -> int:
    """The least of 1, 10, ..., a million at which ``rows`` come down to what is wanted."""
    return next((10**k for k in range(6) if rows <= wanted * 10**k), 10**6)
