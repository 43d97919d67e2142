"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...  All words of all sources are
shared out by weight; a source's target stops at ``epochs`` times its size and the excess is shared
again by weight until none is above.  The fixed point of that loop is a water level: with sources in
order of cap / weight, it is the first (total - caps before) / (weights from here on) that is not
above its own cap / weight, which two windows over the sources compute.

Every document is taken floor(target / size) times whole; the fractional repetition goes to
documents in the order of a seeded MD5 of their id until it is used up, to the nearest document.
The order is cut in two steps, so that no task sees a whole source: sums of 4,096 hash buckets
find the bucket of the cut, and only that bucket's documents are ordered.

Nulls: a null text has size 0, a null source is a source of its own.  A source without words has
target 0 and is taken 0 times.  Rows of the same id and source are taken together.  Empty table:
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RUN, broadcast_if_small, stage

SEED = "mix-1"
#: Sources up to which their plan (about 60 bytes each) is broadcast.
MAX_BROADCAST_SOURCES = 100_000


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RUN)).cast("long")


def _order(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target)."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    w = w.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("from_here", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("water", (F.col("total") - F.col("before")) / F.col("from_here"))
    w = w.withColumn("water", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(everything)["water"])
    return w.select("source", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, plan): rows (doc_id, source, size, h); per source its size, target, whole
    repetitions and the last hash that gets one more."""
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _order(F.col(id_col)).alias("h")), "sizes")
    bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    sums = stage(rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("s")), "bucket-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = stage(goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    n = goal.count()
    to_goal = lambda df: df.join(broadcast_if_small(goal.withColumnRenamed("source", "g_source"), n, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    run = Window.partitionBy("source").orderBy("b")
    cut = (
        to_goal(sums.withColumn("upto", F.sum("s").over(run)))
        .where((F.col("upto") - F.col("s") < F.col("part")) & (F.col("part") <= F.col("upto")))
        .select(F.col("source").alias("c_source"), F.col("b").alias("c_b"), (F.col("upto") - F.col("s")).alias("c_before"), F.col("part").alias("c_part"))
    )
    cut = stage(cut, "cuts")
    # Only the documents of the cut's bucket are ordered one by one.
    edge = rows.withColumn("b", bucket).join(broadcast_if_small(cut, n, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("b") == F.col("c_b")))
    edge = edge.groupBy("source", "h", "c_before", "c_part").agg(F.sum("size").alias("s"))
    edge = edge.withColumn("upto", F.col("c_before") + F.sum("s").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.where(2 * F.col("upto") - F.col("s") <= 2 * F.col("c_part")).groupBy("source").agg(F.max("h").alias("last_h"))
    bound = cut.select("c_source", F.concat(F.lpad(F.lower(F.hex(F.col("c_b"))), 3, "0")).alias("edge_h"))
    # Below the cut's bucket every hash is taken, also where none in the bucket is.
    made = (
        goal.join(bound, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .drop("c_source")
        .join(last.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("last_h", "edge_h", F.lit("")).alias("last_h"))
    )
    return rows, stage(made, "mix-plan")


def _copies(h: Column) -> Column:
    return F.col("m_whole") + (h <= F.col("m_last")).cast("long")


def _joined(rows: DataFrame, source: Column, made: DataFrame) -> DataFrame:
    named = made.select(F.col("source").alias("m_source"), F.col("source_size").alias("m_size"), F.col("target").alias("m_target"), F.col("whole").alias("m_whole"), F.col("last_h").alias("m_last"))
    return rows.join(broadcast_if_small(named, made.count(), MAX_BROADCAST_SOURCES), source.eqNullSafe(F.col("m_source")))


def mixed(docs: DataFrame, epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows, made = plan(docs, epochs)
    out = _joined(rows, F.col("source"), made)
    return out.select("doc_id", "size", F.col("m_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("size") * _copies(F.col("h"))).alias("taken"))


def repeat_documents(docs: DataFrame, epochs: int = 3, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with their columns."""
    _, made = plan(docs, epochs, id_col=id_col, source_col=source_col)
    # The user's columns travel as one struct, so that none of theirs meets one of ours.
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("row_source"), _order(F.col(id_col)).alias("h"))
    out = _joined(packed, F.col("row_source"), made).withColumn("copies", _copies(F.col("h"))).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS level, sum(source_size::DOUBLE) OVER () AS total FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
             sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM l),
f AS (SELECT arg_min((total - before) / from_here, level) AS water FROM c WHERE (total - before) / from_here <= level),
t AS (SELECT source, source_size, least(cap, water * weight) AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, h, sum(size) AS gs FROM d GROUP BY source, h),
u AS (SELECT source, h, gs, sum(gs) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM g),
k AS (SELECT u.source, max(h) AS last_h FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
      WHERE target - whole * source_size > 0 AND 2 * upto - gs <= 2 * (target - whole * source_size) GROUP BY u.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN d.h <= k.last_h THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
