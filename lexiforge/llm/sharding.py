"""Contiguous shards of near equal bytes, with DataFrame functions only.

The documents in order of their id get global prefix sums of their byte sizes: rows of ids, sizes and
checksums are range-partitioned, one total a partition gives each its start, and a window adds the
sums inside.  The order is cut at equal targets: with n shards of total T, shard k holds what lies from
k T / n to (k + 1) T / n, and a document belongs where its middle lies.  So every cut is at the document
edge nearest its target, every shard is a run of ids, and its bytes differ from T / n by no more than the
sizes of the documents at its two ends.

Size is the text's UTF-8 bytes plus 8 for its record; a null text has 8 bytes and the checksum of the
empty text.  Null ids come last.  Rows of one id, also equal rows, are put one by one, those of less
size first, then of smaller checksum.  A text larger than a shard's target has its shard for itself and
its neighbours' shards may stay empty.  Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checksums import crc32_sql
from .ordering import running

SHARDS = 24
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = running(rows, [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")], "size")
    middle = 2 * F.col("before") + F.col("size")
    placed = placed.withColumn("shard", F.call_function("div", middle * shards, 2 * F.col("total")).cast("int"))
    # At most one row a shard.
    firsts = placed.groupBy(F.col("shard").alias("f_shard")).agg(F.min("index").alias("first"))
    out = placed.join(F.broadcast(firsts), F.col("shard") == F.col("f_shard"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def op12_byte_shards(spark, sf_dir: str) -> DataFrame:
    out = shards_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {RECORD_BYTES} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
p AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM d
      WINDOW w AS (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, ((2 * before + size) * {SHARDS} // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM s
"""
