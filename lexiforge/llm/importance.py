"""Importance resampling towards a target distribution of hashed n-grams.

Two passes over the documents.  The first counts all n-grams of the documents, and of the target texts,
by bucket: each task interns its n-grams (ngrams.py), adds up its tables' counts in one array of buckets
and puts out that array once.  The gains of the buckets, one number each, go to the tasks of the
second pass, which gathers them through the occurrences' places and takes each document's floored
mean as its weight.  A Gumbel number from a seeded hash of the id is added, and the highest scores are
drawn: sampling without replacement in proportion to exp(weight / 1000).  Ranks are places in the whole
order (ordering.py), so no task sorts all documents.

Nulls: a null text has no words, a null id is hashed as "null" and stands behind equal scores.  Equal
rows are drawn one by one; ties go to the smaller id.  Long texts are taken whole, in runs of n-grams.
No documents: empty result; an empty target leaves every feature with the prior's gain.  Other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checksums import crc32_sql
from .common import lean, slices, stage, texts_of
from .ngrams import tables, words_of
from .ordering import running

BUCKETS, N_MAX, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, "7"
#: Bytes of text whose words are looked up at once, one text at least.
SLICE_BYTES = 1 << 20


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, n_max: int = N_MAX) -> DataFrame:
    """(bucket, n): occurrences of n-grams in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            for table, _ in tables(words_of(texts_of(batch, "text")), n_max, buckets):
                used = np.flatnonzero(table.count)
                sums += np.bincount(table.bucket[used], table.count[used], buckets).astype(np.int64)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(sums[met], pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log ratio of the smoothed frequencies in the target and in the source, floored,
    by bucket.  The counts, one row a bucket, come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    s_all, t_all = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s_all + buckets) / ((a + 1) * (t_all + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n_max: int = N_MAX) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            words = words_of(texts_of(batch, "text"))
            features, gained = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for table, rows in tables(words, n_max, len(gain)):
                features += np.bincount(rows, minlength=n)
                # Sums of whole numbers far below 2^53 are exact in doubles.
                gained += np.bincount(rows, gain[table.bucket][table.slot], n).astype(np.int64)
            weight = np.where(features > 0, gained // np.maximum(features, 1), 0)
            counts = np.bincount(words.rows, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A document's Gumbel number in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, "text"))
    # Written before it is sorted: finding the ranges of the order reads the rows a second time.
    scored = stage(weights(docs, gain, id_col, text_col), "weights").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))).withColumn("enough", (F.col("n_words") >= min_words).cast("long"))
    placed = running(scored, [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "enough")
    # total: the documents with enough words; they come first.
    drawn = (F.col("enough") == 1) & (F.col("index") < F.floor(F.col("total") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("index") + 1).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns.  An id that several rows share is drawn with all of
    them if any of them is."""
    ids = resampled(docs, target, percent, id_col=id_col).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_col) == F.col("_drawn"), "left_semi")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resampled(read("documents"), read("benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _grams_sql(table: str, name: str) -> str:
    """Per row of table its id, words and their one- and two-word runs."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT row_number() OVER () AS r, {name}, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM (SELECT {name}, {words} AS w FROM {table})"


ORACLE = f"""
WITH d AS ({_grams_sql("documents", "doc_id")}),
e AS ({_grams_sql("benchmark", "item_id")}),
f AS (SELECT r, unnest(grams) AS gram FROM d),
g AS (SELECT unnest(grams) AS gram FROM e),
k AS (SELECT gram, {crc32_sql("gram")} % {BUCKETS} AS bucket FROM (SELECT gram FROM f UNION SELECT gram FROM g)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM f JOIN k USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM g JOIN k USING (gram) GROUP BY bucket),
n AS (SELECT (SELECT sum(s) FROM s) AS sa, coalesce((SELECT sum(t) FROM t), 0) AS ta),
b AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (sa + {BUCKETS}) / ((s + 1) * (ta + {BUCKETS})))) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN k USING (gram) JOIN b USING (bucket) GROUP BY r),
o AS (SELECT doc_id, len(w) AS words, len(grams) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, words >= {MIN_WORDS} AS enough FROM o),
p AS (SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE enough) OVER () AS total FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= {PERCENT} * total // 100 THEN place END AS rank FROM p
"""
