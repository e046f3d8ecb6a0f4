"""Operators on streams: those that need time, beside the row-wise ones, which take streams as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.values import col
from geoloom.operators.summarise import AGGREGATES


def windowed_aggregate(df: DataFrame, time: str, window: str, late: str, group_by: Sequence[str] = (), aggregates: Sequence[tuple[str, str | None, str | None]] = ()) -> DataFrame:
    """``window_start, window_end``, the groups and their aggregates for each window of time.

    ``late`` is how long late rows are waited for; a window is final, and its state goes, once that has passed. On a
    table, which ends, it is the plain aggregate. Medians and distinct counts need whole windows and work on tables.
    """
    out = [(F.count(F.lit(1)) if not c else AGGREGATES[f](col(c))).alias(name or f"{f.replace(' ', '_')}_{c or 'all'}") for f, c, name in aggregates]
    marked = _timed(df, time).withWatermark(time, late) if df.isStreaming else _timed(df, time)
    got = marked.groupBy(F.window(col(time), window).alias("_w"), *map(col, group_by)).agg(*(out or [F.count(F.lit(1)).alias("count")]))
    return got.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[col(c) for c in got.columns if c != "_w"])


def first_of_stream(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The rows that are the first of their key within the time that late rows are waited for; state stays bounded."""
    return _timed(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Event times without a zone are taken in the session's."""
    return df.withColumn(time, col(time).cast("timestamp")) if dict(df.dtypes)[time] == "timestamp_ntz" else df
