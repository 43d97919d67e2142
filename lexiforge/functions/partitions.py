"""Tasks in proportion to the rows, where a task holds its rows in memory.

Adaptive execution puts partitions together, and the planner broadcasts, by compressed bytes.  Of narrow rows with
ascending keys these are few, and many times more in memory; so joins of such rows are dealt by their count."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of all sides of a join that one task gets, about; sorting takes up to 300 bytes of memory for each.
TASK_ROWS = 500_000


def parts_for(*tables: DataFrame) -> int | None:
    """How many partitions the counted rows of all tables together need; None where they are few."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)) if rows > TASK_ROWS else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """One side of a sort-merge join on the keys, in so many partitions; None leaves it to Spark."""
    return df if parts is None else df.repartition(parts, *keys).hint("merge")
