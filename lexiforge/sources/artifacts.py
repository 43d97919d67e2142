"""Readers of stored artifacts: registry, ordered documents, chunk files and snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "document_id string, original_filename string, status string, stage string, revision string, page_count int, page_kind string, chunk_count int, failure_code string, enabled boolean, alias string"


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of records, or lines of them; undeclared keys are ignored."""
    return _json(spark, path, REGISTRY, lines)


def ordered_documents(spark: SparkSession, pattern: str, registry: DataFrame, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents of the registry that have an ordered file, those that lack one)."""
    found = _json(spark, pattern, schema, lines)
    known = registry.select("document_id")
    return found.join(known, "document_id", "left_semi"), known.join(found.select("document_id"), "document_id", "left_anti")


def readable_chunks(lines: DataFrame, schema: str) -> DataFrame:
    """lines (file, value) of JSON to rows, without files that have a bad or nameless row."""
    rows = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = rows.withColumn("broken", F.col("row").isNull() | F.col("row._bad").isNotNull() | F.col("row.chunk_id").isNull())
    bad = rows.groupBy("file").agg(F.bool_or("broken").alias("broken")).where("broken").select("file")
    return rows.join(bad, "file", "left_anti").select("file", "row.*").drop("_bad")


class SnapshotError(Exception):
    """A published snapshot can't be read: not_published, version_missing or manifest_missing."""


def _present(read, code: str):
    try:
        return read()
    except AnalysisException as e:
        raise SnapshotError(code) from e


def _current(spark: SparkSession, root: str) -> str:
    """The folder of the version that the pointer names; the pointer is read once per query."""
    pointer = _present(lambda: spark.read.text(f"{root}/current"), "not_published").first()
    if pointer is None or not pointer[0].strip():
        raise SnapshotError("not_published")
    return f"{root}/{pointer[0].strip()}"


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The vectors of the published version."""
    folder = _current(spark, root)
    return _present(lambda: spark.read.parquet(f"{folder}/vectors"), "version_missing")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    folder = _current(spark, root)
    return _present(lambda: spark.read.json(f"{folder}/manifest"), "manifest_missing")
