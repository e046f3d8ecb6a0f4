"""All queries of the library outside geoloom.llm, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans import files, relational, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **spatial.QUERIES, **files.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **spatial.ORACLES, **files.ORACLES}
