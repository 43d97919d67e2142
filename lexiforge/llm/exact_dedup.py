"""Exact deduplication with a heavy-hitter split.

Each text is normalised (runs of U+0020 and U+0009-U+000D become one space; null is empty) and
named by its SHA-256.  Misra-Gries summaries, one per partition, find the digests that may be
frequent; summed by digest, at most ``counters`` of them can exceed n / counters, which is the
proven bound of what is broadcast.  The candidates' exact winners (smallest id, group size) are
then counted and broadcast, so their rows are decided on the map side.  All other digests have
few rows each, 2 n / counters at most, and go through an ordinary shuffle on the digest: their
winners are partial aggregates, and the join back is one that Spark can split.

Nulls: a null text equals an empty one; a null id sorts after all others and can only be kept
when its group has no other id.  Repeated rows (same id, same text): exactly one is kept.
Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, fresh, stage


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256)


def misra_gries(counters: int):
    """Batches of digests in, the partition's summary out: at most ``counters`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                kept[pair["values"]] = kept.get(pair["values"], 0) + pair["counts"]
            if len(kept) > counters:
                # Merging whole batches: take the (counters + 1)-th largest count off all.
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {k: v - cut for k, v in kept.items() if v > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.string()), "c": pa.array(list(kept.values()), pa.int64())})

    return run


def heavy_digests(digests: DataFrame, n: int, counters: int = 1024, min_count: int = 64) -> DataFrame:
    """Digests whose summed lower bounds reach n / counters: at most ``counters`` rows.

    A summary falls short of the true count by at most n / (counters + 1) in all, so every digest
    with more than 2 n / counters rows is found."""
    parts = digests.select("digest").mapInArrow(misra_gries(counters), "digest string, c long")
    return parts.groupBy("digest").agg(F.sum("c").alias("c")).where(F.col("c") >= max(min_count, n / counters)).select("digest")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A digest's winner is the least of (id, number of the row), so one aggregate names it, also where
    rows are repeated; no group is sorted or held by one task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("r"))
    rows = stage(rows, "digests")
    heavy = stage(heavy_digests(rows, rows.count(), counters), "heavy")
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "r")).alias("winner")
    summed = lambda df: df.groupBy(F.col("digest").alias("w_digest")).agg(winner, F.count(F.lit(1)).alias("group_size"))
    hot = stage(summed(rows.join(F.broadcast(heavy), "digest", "left_semi")), "winners")
    others = rows.join(F.broadcast(heavy), "digest", "left_anti")
    same = F.col("digest") == F.col("w_digest")
    out = rows.join(F.broadcast(hot), same).unionByName(others.join(summed(others), same))
    return out.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("r") == F.col("winner.r")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns.  Of rows with one id and equal texts one stays; where
    such rows differ in other columns, any of them."""
    decided = decide(docs, id_col, text_col)
    sha, k_id, k_sha = fresh(docs, "sha", "k_id", "k_sha")
    kept = decided.where("kept").select(F.col("doc_id").alias(k_id), F.col("text_sha256").alias(k_sha))
    joined = docs.withColumn(sha, digest(F.col(text_col))).join(kept, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha)), "left_semi")
    repeated = decided.where("not kept and doc_id <=> keep_id")
    return (joined if repeated.isEmpty() else joined.dropDuplicates([id_col, sha])).drop(sha)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
