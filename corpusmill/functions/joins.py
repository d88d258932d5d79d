"""Joins with a side whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast: some tens of megabytes on each executor.
ROWS = 1_000_000


def bounded(table: DataFrame, rows: int = ROWS) -> DataFrame:
    """``table``, to be broadcast if it has at most so many rows; a larger one is joined by shuffling both sides.

    Meant for materialised tables of a few narrow columns, whose rows are counted from file footers.
    """
    return F.broadcast(table) if table.count() <= rows else table


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows that cost much and hold little, dealt by ``keys`` to enough tasks: by their size alone Spark would put them into a few."""
    parallel = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(parallel, n // 100))), *keys)
