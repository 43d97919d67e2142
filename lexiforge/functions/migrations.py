"""Versioned state tables: each version is a folder, and a pointer names the one in use."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forward-only steps: the columns, with type and default, that each version adds to its table.
STEPS = (
    ("sessions", {"session_id": ("long", None), "updated_at": ("string", None)}),
    ("sessions", {"scope_json": ("string", None)}),
    ("sessions", {"summary_failures": ("int", 0)}),
)


def stored_version(spark: SparkSession, root: str) -> int:
    """The version in use; 0 where there is none."""
    try:
        row = spark.read.schema("version int").json(f"{root}/schema_version").first()
    except AnalysisException:
        return 0
    return row[0] if row else 0


def _folder(root: str, version: int, table: str) -> str:
    return f"{root}/v{version}/{table}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(_folder(root, stored_version(spark, root), table))


def store_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], version: int) -> None:
    """Writes the tables as a version; the pointer moves last, so a failure leaves the old version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(_folder(root, version, name))
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").json(f"{root}/schema_version")


def migrate(spark: SparkSession, root: str) -> int:
    """Brings the stored tables to the newest version by the steps after theirs; returns it."""
    version = stored_version(spark, root)
    if version >= len(STEPS):
        return version
    names = {table for table, _ in STEPS}
    tables = {}
    for name in names:
        old = sum(([*added] for table, added in STEPS[:version] if table == name), [])
        df = spark.read.parquet(_folder(root, version, name)) if old else None
        for table, added in STEPS[version:]:
            if table != name:
                continue
            if df is None:
                df = spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, (kind, _) in added.items()))
            else:
                df = df.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in added.items() if c not in df.columns})
        tables[name] = df
    store_tables(spark, root, tables, len(STEPS))
    return len(STEPS)
