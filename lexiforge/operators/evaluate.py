"""Evaluation: ranks of targets, recall, reciprocal ranks, noise, outcomes and trace assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.partitions import dealt

#: Verdict limits and the repeated-call limit.
MEDIAN_LIMIT, NOISE_LIMIT, REPEATED_CALLS = 10, 0.20, 3
OUTCOMES = ("transport_error", "gate_failed", "budget_exhausted", "refuse_correct", "unfounded_answer", "deny_unverified", "no_answer", "no_citation", "adjacent_page", "ok")


def target_ranks(targets: DataFrame, results: DataFrame, parts: int | None = None) -> DataFrame:
    """targets (question, target, page[, document]) and results (question, rank, page, document): the
    first rank at which each target's page shows up; null if it never does.  parts as of parts_for."""
    t = dealt(targets, parts, "question", "page").select("question", "target", F.col("page").alias("t_page"), F.col("document").alias("t_document"))
    same = (F.col("page") == F.col("t_page")) & (F.col("t_document").isNull() | (F.col("document") == F.col("t_document")))
    joined = t.join(dealt(results, parts, "question", "page").withColumnRenamed("question", "r_question"), (t["question"] == F.col("r_question")) & same, "left")
    return joined.groupBy("question", "target").agg(F.min("rank").alias("rank"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to 4; 0.0 without a whole."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def retrieval_summary(ranks: DataFrame, k: int, cuts: tuple[int, ...] = (5, 10, 50)) -> DataFrame:
    """ranks (question, target, rank) of answerable questions to one row of metrics."""
    best = ranks.groupBy("question").agg(F.min("rank").alias("best"))
    n = F.count(F.lit(1))
    return best.agg(
        n.alias("questions"),
        *(ratio(F.count_if(F.col("best") <= c), n).alias(f"recall_{c}") for c in cuts),
        ratio(F.sum(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), n).alias("mrr"),
        F.coalesce(F.median("best"), F.lit(float(k + 1))).alias("median_rank"),
    )


def percentile(rows: DataFrame, key: str, value: str, fraction: float, name: str) -> DataFrame:
    """(key, name): the value at round-half-even(fraction * (n - 1)) of each key's sorted values.

    Equal values are counted first, so what is sorted per key is its distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.bround(F.lit(fraction) * (F.sum("n").over(w) - 1)) + 1
    return counts.withColumn("upto", upto).withColumn("wanted", wanted).where("upto >= wanted and upto - n < wanted").select(key, F.col(value).alias(name))


def shown_page(cited: Column, page: Column, page_end: Column) -> Column:
    """The cited page where the passage covers it, else the page on which the passage begins."""
    inside = cited.between(page, F.coalesce(page_end, page))
    return F.when(page.isNull(), cited).when(F.coalesce(inside, F.lit(False)), cited).otherwise(page)


def fidelity(cited: Column, page: Column, page_end: Column) -> Column:
    return F.when(cited.between(page, F.coalesce(page_end, page)), "match").otherwise("mismatch")


def resolved_expect(expect: Column, answerable: Column) -> Column:
    """The expectation that a question states, or else answer or deny."""
    stated = F.nullif(F.trim(expect), F.lit(""))
    return F.coalesce(stated, F.when(answerable, "answer").otherwise("deny"))


def health(loaded: Column, documents: Column) -> Column:
    return F.when(F.coalesce(loaded, F.lit(False)) | (documents == 0), "ok").otherwise("degraded")


def most_common(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's most frequent value; of ties the one seen first."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "seen")
    return counts.withColumn("turn", F.row_number().over(best)).where("turn = 1").drop("turn", "seen")


def needs_reranker(median_rank: Column, noise: Column, k: int) -> Column:
    return (median_rank <= k) & ((median_rank > MEDIAN_LIMIT) | (noise >= NOISE_LIMIT))


def outcome() -> Column:
    """One outcome per row, by the first rule that holds.  Columns: error, gate_failed, exhausted,
    refused, expect (answer, deny or refuse), answered, cited, hit."""
    c = F.col
    return (
        F.when(c("error"), "transport_error")
        .when((c("expect") == "refuse") & c("refused"), "refuse_correct")
        .when((c("expect") == "refuse") & c("answered"), "unfounded_answer")
        .when(c("gate_failed"), "gate_failed")
        .when(c("exhausted"), "budget_exhausted")
        .when(c("expect") == "deny", "deny_unverified")
        .when(~c("answered"), "no_answer")
        .when(~c("cited"), "no_citation")
        .when(~c("hit"), "adjacent_page")
        .otherwise("ok")
    )


def number_coverage(reference: Column, answer: Column) -> Column:
    """Share of the reference's distinct numbers that the answer has; null without numbers."""
    pattern = F.lit(r"(\d+(?:\.\d+)?)")
    want = F.array_distinct(F.regexp_extract_all(reference, pattern, F.lit(1)))
    have = F.regexp_extract_all(answer, pattern, F.lit(1))
    return F.when(F.size(want) > 0, F.round(F.size(F.array_intersect(want, have)) / F.size(want), 3))
