"""Cross-site line deduplication with DataFrame functions only.

A line, trimmed of U+0020 and U+0009-U+000D, is named by its MD5.  HyperLogLog sketches of the sites
that hold it are merged by aggregation, with partial sketches before the shuffle.  Lines whose
estimate is well above ``min_sites`` are boilerplate; those within the sketch's error of it get an
exact count of distinct sites.  Boilerplate lines are then removed from all documents: on the map
side where they are few, by a join on the documents' texts beyond.

Nulls: a null text has no lines; a null site counts as one site; a null id is kept.  Lines that are
empty once trimmed are never boilerplate.  Rows of the same id are cleaned each by its own text.
Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage

MIN_SITES = 5
#: Sketches of 2^LG_K places; three standard errors are about MARGIN.
LG_K, MARGIN = 10, 0.15
#: Boilerplate lines (some 80 bytes each) up to which they are broadcast.
MAX_BROADCAST_LINES = 100_000
#: Boilerplate lines (a hash of 32 characters each) up to which they become literals of the plan.
MAX_LITERAL_LINES = 10_000
_TRIM = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(_TRIM)))


_BLANK = "d41d8cd98f00b204e9800998ecf8427e"  # MD5 of an empty line


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """lines (h, site) to the hashes (h) of lines on min_sites sites or more."""
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    likely = stage(sketched.where(F.col("sites") >= min_sites * (1 - MARGIN)), "likely-lines")
    sure = F.col("sites") >= min_sites * (1 + MARGIN)
    near = likely.where(~sure).select("h")
    near = broadcast_if_small(near, near.count(), MAX_BROADCAST_LINES)
    counted = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites"))
    return likely.where(sure).select("h").unionByName(counted.where(F.col("sites") >= min_sites).select("h"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, clean (its lines without boilerplate)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"))
    lines = named.select("doc_id", "site", F.explode(F.transform(F.split("text", "\n"), _key)).alias("h")).where(F.col("h") != _BLANK)
    found = stage(boilerplate(lines.select("h", "site"), min_sites), "boilerplate")
    many = found.count()
    rows = named.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    if many <= MAX_LITERAL_LINES:
        # A counted, small set of hashes goes to the texts as a set of literals: no text is moved.
        hashes = [r["h"] for r in found.collect()]
        rows = rows.withColumn("kept", F.filter("lines", lambda line: ~_key(line).isin(hashes)) if hashes else F.col("lines"))
    else:
        # Whether a line goes does not depend on the document, so one set per text serves all its rows.
        keyed = named.withColumn("body", F.xxhash64("text"))
        small = broadcast_if_small(found, many, MAX_BROADCAST_LINES)
        hit = keyed.select("doc_id", "body", F.explode(F.transform(F.split("text", "\n"), _key)).alias("h")).join(small, "h", "left_semi")
        gone = hit.groupBy(F.col("doc_id").alias("g_id"), F.col("body").alias("g_body")).agg(F.collect_set("h").alias("gone"))
        rows = rows.withColumn("body", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("body") == F.col("g_body")), "left")
        kept = F.filter("lines", lambda line: ~F.array_contains("gone", _key(line)))
        rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = (F.size("lines") - F.size("kept")).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), removed.alias("n_removed"), F.array_join("kept", "\n").alias("clean"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean").cast("long").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"))


ORACLE = rf"""
WITH l AS (SELECT rowid AS r, doc_id, text IS NULL AS none, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT k.*, b.key IS NULL AS stays FROM k LEFT JOIN b USING (key)),
c AS (SELECT r, doc_id, count(*) FILTER (WHERE NOT none) AS n, count(*) FILTER (WHERE NOT stays) AS gone,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS clean FROM m GROUP BY r, doc_id)
SELECT doc_id, n AS n_lines, gone AS n_removed, length(clean) AS clean_chars, sha256(clean) AS clean_sha256 FROM c
"""
