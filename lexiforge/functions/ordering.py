"""Positions in a whole order without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import work_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written in the work folder and read back: its lineage ends here."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix_sums(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the running sum of value over all rows in the order of bucket, then ``order``.

    bucket ascends with the order and has few rows each; only one sum a bucket meets in one task."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.withColumn(name, F.col("_start") + F.sum("_value").over(inside)).drop("_bucket", "_value", "_b", "_start")


def running(rows: DataFrame, by: list[Column], value: str | None = None, stage: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows with ``index``, the number of rows before each in the order ``by``, and with a value column
    also ``before``, the sum of the values before it, and ``total``, the sum of all.

    The rows are range-partitioned and written, one total of each partition meets the others in
    one task, and a window adds the sums inside a partition.  Rows equal in ``by`` are told apart by
    where they were read, so that a key that many rows share is split as well; which of them comes
    first is not defined.
    """
    tie, part, start, start_value, n, s = fresh_names(rows, "_tie", "_part", "_start", "_start_value", "_n", "_s")
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by, F.col(tie))
    placed = stage(spread.withColumn(part, F.spark_partition_id()), "ordered")
    amount = F.col(value).cast("long") if value else F.lit(0).cast("long")
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.sum(amount).alias(s))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # One row a partition: its number is the session's shuffle partitions, whatever the input.
    starts = totals.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(start), F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(start_value), F.sum(s).over(every).alias("total"))
    inside = Window.partitionBy(part).orderBy(*by, F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({n: F.row_number().over(inside), s: F.sum(amount).over(inside) - amount}).join(F.broadcast(starts), part)
    out = out.withColumn("index", F.col(start) + F.col(n) - 1)
    out = out.withColumn("before", F.col(start_value) + F.col(s)) if value else out.drop("total")
    return out.drop(tie, part, start, start_value, n, s)
