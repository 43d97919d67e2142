"""Index snapshots: reuse plans, vectors of old versions, publication, manifest and registry."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fingerprint's keys, ages and the metadata that is published.
FINGERPRINT = ("chunker_version", "chunking_config", "parser_config", "element_schema_version", "embedding_model")
LOCK_TTL_S, STAGING_AGE_S = 3600, 3600


def reuse_plan(current: DataFrame, previous: DataFrame, same_fingerprint: Column) -> DataFrame:
    """current and previous (document_id, revision, chunk_count) to (document_id, reason): reused, or
    why the document is chunked again."""
    p = previous.select("document_id", F.col("revision").alias("p_revision"), F.col("chunk_count").alias("p_count"))
    rows = current.join(p, "document_id", "left")
    reason = (
        F.when(~same_fingerprint, "fingerprint_changed")
        .when(F.col("p_revision").isNull(), "new_document")
        .when(F.col("revision") != F.col("p_revision"), "revision_changed")
        .when(F.col("chunk_count").isNull(), "chunks_unreadable")
        .when(F.col("chunk_count") != F.col("p_count"), "count_mismatch")
        .otherwise("reused")
    )
    return rows.select("document_id", reason.alias("reason"))


def reuse_vectors(chunks: DataFrame, previous: DataFrame, embed) -> DataFrame:
    """chunks (chunk_id, text) with the vectors of the same ids; only the rest is embedded."""
    old = previous.select("chunk_id", "v").dropDuplicates(["chunk_id"])
    kept = chunks.join(old, "chunk_id").withColumn("reused", F.lit(True))
    fresh = chunks.join(old, "chunk_id", "left_anti").withColumn("v", embed(F.col("text"))).withColumn("reused", F.lit(False))
    return kept.unionByName(fresh)


def flat_metadata(df: DataFrame, keep: list[str]) -> DataFrame:
    """One JSON text per row: only ``keep``, nulls left out, booleans as 0 or 1, arrays as JSON."""
    fields = []
    for f in df.schema:
        if f.name in keep:
            kind, c = f.dataType.typeName(), F.col(f.name)
            fields.append((c.cast("int") if kind == "boolean" else F.to_json(c) if kind in ("array", "struct", "map") else c).alias(f.name))
    return df.select(F.to_json(F.struct(*fields)).alias("metadata"))


def compatible(model: Column, dimension: Column, want_model: str, want_dimension: int) -> Column:
    return F.when(model != want_model, "model_mismatch").when(dimension != want_dimension, "dimension_mismatch").otherwise("ok")


def lock_state(age_s: Column, same_host: Column, alive: Column, readable: Column) -> Column:
    """Whether a build lock is held, or why it may be taken over."""
    return F.when(~readable, "unreadable").when(age_s.isNull(), "no_start_time").when(age_s > LOCK_TTL_S, "expired").when(same_host & ~alive, "holder_gone").otherwise("held")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def publish(vectors: DataFrame, manifest: DataFrame, root: str) -> str:
    """Writes a version beside the live one, renames it, then moves the pointer; a failure leaves the
    live version as it was.  Returns the version's name."""
    spark = vectors.sparkSession
    fs, path = _fs(spark, root)
    version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    staging = f"{root}/.building-{version}"
    try:
        vectors.write.parquet(f"{staging}/vectors")
        manifest.coalesce(1).write.json(f"{staging}/manifest")
        if not fs.rename(path(staging), path(f"{root}/{version}")):
            raise OSError("the version could not be renamed")
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/.next")
        fs.delete(path(f"{root}/current"), True)
        fs.rename(path(f"{root}/.next"), path(f"{root}/current"))
    except Exception:
        fs.delete(path(staging), True)
        raise
    collect_garbage(spark, root, version)
    return version


def collect_garbage(spark: SparkSession, root: str, keep: str, staging_age_s: int = STAGING_AGE_S) -> list[str]:
    """Deletes versions other than ``keep`` and old staging folders; returns their names."""
    fs, path = _fs(spark, root)
    gone = []
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        old = time.time() - status.getModificationTime() / 1000 > staging_age_s
        if (name.startswith("v") and name != keep) or (name.startswith(".building-") and old):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone


def inside(path: Column, folder: str) -> Column:
    """Whether a path, its dots resolved, lies in the folder."""
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    base = [p for p in folder.split("/") if p not in ("", ".")]
    return F.slice(parts, 1, len(base)) == F.array(*(F.lit(p) for p in base))


def guarded_output(path: str, protected: str) -> str:
    """The path, unless it is inside the protected folder."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    base = [p for p in protected.split("/") if p not in ("", ".")]
    if parts[: len(base)] == base:
        raise ValueError(f"{path} is inside {protected}")
    return path
