"""Evaluation queries: orders are questions, their lines ranked results; events are traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import as_int, query
from ..functions.ordering import prefix_sums
from ..functions.partitions import dealt, parts_for
from ..operators import evaluate as V


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int | None]:
    """(targets, results, the partitions that a join of them needs).

    Results are the lines of an order, ranked by price: page = partkey mod 40, document = suppkey mod 10.  Each
    order asks for two pages; the second of one document only."""
    o, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    first = o.select(F.col("o_orderkey").alias("question"), F.lit(1).alias("target"), (F.col("o_custkey") % 40).alias("page"), F.lit(None).cast("long").alias("document"))
    second = o.select(F.col("o_orderkey").alias("question"), F.lit(2).alias("target"), (F.col("o_orderkey") % 40).alias("page"), (F.col("o_custkey") % 10).alias("document"))
    parts = parts_for(o, o, lines)
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    rows = dealt(lines, parts, "l_orderkey").withColumn("rank", F.row_number().over(w))
    results = rows.select(F.col("l_orderkey").alias("question"), "rank", (F.col("l_partkey") % 40).alias("page"), (F.col("l_suppkey") % 10).alias("document"))
    return first.unionByName(second), results, parts


EV = """
res AS (SELECT l_orderkey AS question, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber)::INT AS rank, l_partkey % 40 AS page, l_suppkey % 10 AS document FROM lineitem),
tg AS (SELECT o_orderkey AS question, 1 AS target, o_custkey % 40 AS page, NULL::BIGINT AS document FROM orders UNION ALL SELECT o_orderkey, 2, o_orderkey % 40, o_custkey % 10 FROM orders),
rk AS (SELECT t.question, t.target, min(r.rank) AS rank FROM tg t LEFT JOIN res r ON r.question = t.question AND r.page = t.page AND (t.document IS NULL OR t.document = r.document) GROUP BY 1, 2),
bt AS (SELECT question, min(rank) AS best FROM rk GROUP BY 1)
"""


def _ev(body: str) -> str:
    return f"WITH {EV}{body}"


@query("J8_target_first_rank", _ev("SELECT * FROM rk"))
def j8(spark, d):
    return V.target_ranks(*asked(spark, d))


@query("A7_recall_at_k", _ev("SELECT round(count(*) FILTER (WHERE best <= 1) / count(*), 4) AS recall_1, round(count(*) FILTER (WHERE best <= 3) / count(*), 4) AS recall_3 FROM bt"))
def a7(spark, d):
    return V.retrieval_summary(V.target_ranks(*asked(spark, d)), 7, (1, 3)).select("recall_1", "recall_3")


@query("A8_mean_reciprocal_rank", _ev("SELECT round(sum(coalesce(1.0::DOUBLE / best, 0)) / count(*), 4) AS mrr FROM bt"))
def a8(spark, d):
    return V.retrieval_summary(V.target_ranks(*asked(spark, d)), 7, ()).select("mrr")


@query("A6_median_rank", _ev("SELECT coalesce(median(best), 8.0)::DOUBLE AS median_rank FROM bt"))
def a6(spark, d):
    return V.retrieval_summary(V.target_ranks(*asked(spark, d)), 7, ()).select("median_rank")


@query("A9_noise_ratio", _ev(", n AS (SELECT question, avg((NOT EXISTS (SELECT 1 FROM tg WHERE tg.question = r.question AND tg.page = r.page))::INT) AS noise FROM res r WHERE rank <= 5 GROUP BY 1) SELECT round(avg(noise), 6) AS noise, count(*) AS questions FROM n"))
def a9(spark, d):
    targets, results, parts = asked(spark, d)
    wanted = dealt(targets, parts, "question", "page").select("question", "page", F.lit(0).alias("off")).distinct()
    top = dealt(results.where("rank <= 5"), parts, "question", "page").join(wanted, ["question", "page"], "left")
    per = top.groupBy("question").agg(F.avg(F.coalesce("off", F.lit(1))).alias("noise"))
    return per.agg(F.round(F.avg("noise"), 6).alias("noise"), F.count(F.lit(1)).alias("questions"))


@query("A2_count_if", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS dear FROM orders GROUP BY 1")
def a2(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 100000).alias("dear"))


@query("A4_min_max_mean", "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def a4(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


@query("A5_percentile_half_even", "SELECT c_nationkey, list_sort(list(c_acctbal))[(round_even(0.95 * (count(*) - 1), 0) + 1)::BIGINT] AS p95 FROM customer GROUP BY 1")
def a5(spark, d):
    return V.percentile(spark.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_acctbal", 0.95, "p95")


@query("A10_most_common", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, n * 1000000000 - seen) AS event_type, max(n) AS n FROM c GROUP BY 1")
def a10(spark, d):
    return V.most_common(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_type", "event_id")


@query("A11_ratio_with_denominator", "SELECT lang, count(*) FILTER (WHERE n_chars > 2000) AS n, count(*) AS of_n, round(count(*) FILTER (WHERE n_chars > 2000) / count(*), 4) AS ratio FROM documents GROUP BY 1")
def a11(spark, d):
    part, whole = F.count_if(F.col("n_chars") > 2000), F.count(F.lit(1))
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(part.alias("n"), whole.alias("of_n"), V.ratio(part, whole).alias("ratio"))


@query("A15_any_and_all", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_large FROM lineitem GROUP BY 1")
def a15(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"))


@query("A18_number_coverage", r"""WITH o AS (SELECT o_orderkey, o_custkey || ' and ' || o_orderkey || ' of ' || (o_orderkey % 7) AS ref, 'it was ' || o_orderkey || ', then ' || (o_custkey % 7) AS ans FROM orders)
SELECT o_orderkey, round(len(list_intersect(list_distinct(regexp_extract_all(ref, '\d+(?:\.\d+)?')), list_distinct(regexp_extract_all(ans, '\d+(?:\.\d+)?')))) / len(list_distinct(regexp_extract_all(ref, '\d+(?:\.\d+)?'))), 3) AS coverage FROM o""")
def a18(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.concat_ws(" ", c, F.lit("and"), k, F.lit("of"), k % 7)
    ans = F.concat(F.lit("it was "), k.cast("string"), F.lit(", then "), (c % 7).cast("string"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", V.number_coverage(ref, ans).alias("coverage"))


@query("V11_reranker_verdict", _ev(", p AS (SELECT question % 50 AS part, median(best * 5)::DOUBLE AS m, count(*) AS n FROM bt WHERE best IS NOT NULL GROUP BY 1) SELECT part, m <= 12 AND (m > 10 OR (part / 100.0)::DOUBLE >= 0.2) AS needed FROM p"))
def v11(spark, d):
    """Ranks times five, so that medians lie on both sides of the limits."""
    best = V.target_ranks(*asked(spark, d)).groupBy("question").agg(F.min("rank").alias("best")).where("best is not null")
    per = best.groupBy((F.col("question") % 50).alias("part")).agg(F.median(F.col("best") * 5).alias("m"))
    return per.select("part", V.needs_reranker(F.col("m"), F.col("part") / 100.0, 12).alias("needed"))


_OUT = """o AS (SELECT o_orderkey, o_orderkey % 23 = 0 AS error, o_orderkey % 19 = 0 AS gate_failed, o_orderkey % 17 = 0 AS exhausted, o_orderkey % 4 = 1 AS refused,
CASE WHEN o_orderstatus = 'F' THEN 'answer' WHEN o_orderstatus = 'O' THEN 'deny' ELSE 'refuse' END AS expect, o_orderkey % 5 <> 0 AS answered, o_orderkey % 3 <> 0 AS cited, o_orderkey % 2 = 0 AS hit FROM orders),
oc AS (SELECT *, CASE WHEN error THEN 'transport_error' WHEN expect = 'refuse' THEN CASE WHEN refused THEN 'refuse_correct' WHEN answered THEN 'unfounded_answer' WHEN gate_failed THEN 'gate_failed' WHEN exhausted THEN 'budget_exhausted' ELSE 'no_answer' END
 WHEN gate_failed THEN 'gate_failed' WHEN exhausted THEN 'budget_exhausted' WHEN expect = 'deny' THEN 'deny_unverified' WHEN NOT answered THEN 'no_answer' WHEN NOT cited THEN 'no_citation' WHEN NOT hit THEN 'adjacent_page' ELSE 'ok' END AS outcome FROM o)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    expect = F.when(F.col("o_orderstatus") == "F", "answer").when(F.col("o_orderstatus") == "O", "deny").otherwise("refuse")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", (k % 23 == 0).alias("error"), (k % 19 == 0).alias("gate_failed"), (k % 17 == 0).alias("exhausted"), (k % 4 == 1).alias("refused"),
        expect.alias("expect"), (k % 5 != 0).alias("answered"), (k % 3 != 0).alias("cited"), (k % 2 == 0).alias("hit"),
    )
    return rows.withColumn("outcome", V.outcome())


@query("V14_outcome_classification", f"WITH {_OUT} SELECT o_orderkey, outcome FROM oc")
def v14(spark, d):
    return outcomes(spark, d).select("o_orderkey", "outcome")


@query("V13_expectation", "SELECT item_id, coalesce(CASE WHEN item_id % 3 = 0 THEN 'refuse' END, CASE WHEN item_id % 2 = 0 THEN 'answer' ELSE 'deny' END) AS expect FROM benchmark")
def v13(spark, d):
    k = F.col("item_id")
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", V.resolved_expect(F.when(k % 3 == 0, "refuse").otherwise(" "), k % 2 == 0).alias("expect"))


@query("V16_summary", f"WITH {_OUT} SELECT expect, count(*) AS n, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE answered) AS answered, round(count(*) FILTER (WHERE outcome = 'ok') / count(*), 4) AS hit_all FROM oc GROUP BY 1")
def v16(spark, d):
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("outcome") == "ok")
    return outcomes(spark, d).groupBy("expect").agg(n.alias("n"), ok.alias("ok"), F.count_if("answered").alias("answered"), V.ratio(ok, n).alias("hit_all"))


@query("V15_trace_assertions", "WITH c AS (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error') AS failed_calls, count(*) FILTER (WHERE value IS NULL OR value < 0) AS bad_values, (SELECT count(*) FROM c WHERE c.user_id = e.user_id AND n >= 3) AS repeated FROM events e GROUP BY 1")
def v15(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    base = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed_calls"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad_values"))
    again = rows.groupBy("user_id", "event_type", "props").count().where(F.col("count") >= V.REPEATED_CALLS).groupBy("user_id").agg(F.count(F.lit(1)).alias("repeated"))
    return base.join(again, "user_id", "left").select("user_id", "failed_calls", "bad_values", F.coalesce("repeated", F.lit(0)).alias("repeated"))


@query("V17_page_fidelity", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 40 BETWEEN l_suppkey % 30 AND l_suppkey % 30 + 10 THEN 'match' ELSE 'mismatch' END AS fidelity, CASE WHEN l_partkey % 40 BETWEEN l_suppkey % 30 AND l_suppkey % 30 + 10 THEN l_partkey % 40 ELSE l_suppkey % 30 END AS shown FROM lineitem")
def v17(spark, d):
    cited, low = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", V.fidelity(cited, low, low + 10).alias("fidelity"), V.shown_page(cited, low, low + 10).alias("shown"))


@query("V18_row_builder", _ev(", t AS (SELECT question, count(*) FILTER (WHERE rank IS NOT NULL) AS found, count(*) AS wanted FROM rk GROUP BY 1) SELECT o.o_orderkey AS question, t.found, t.wanted, coalesce(c.c_name, 'unknown') AS asker FROM orders o JOIN t ON t.question = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey"))
def v18(spark, d):
    ranks = V.target_ranks(*asked(spark, d)).groupBy("question").agg(F.count("rank").alias("found"), F.count(F.lit(1)).alias("wanted"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("question"), "o_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    rows = o.join(ranks, "question").join(c, o["o_custkey"] == c["c_custkey"], "left")
    return rows.select("question", "found", "wanted", F.coalesce("c_name", F.lit("unknown")).alias("asker"))


@query("V19_parse_quality", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN 'degraded' WHEN l.toxic = 1 THEN 'partial' ELSE 'ok' END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def v19(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 0, "degraded").when(F.col("toxic") == 1, "partial").otherwise("ok").alias("quality"))


@query("V24_trace_normalization", "SELECT event_id, event_type AS tool, event_type <> 'error' AS ok, CASE WHEN event_type IN ('view', 'click') THEN 'direct' ELSE 'planned' END AS track, round(value, 3) AS duration FROM events")
def v24(spark, d):
    t = F.col("event_type")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", t.alias("tool"), (t != "error").alias("ok"), F.when(t.isin("view", "click"), "direct").otherwise("planned").alias("track"), F.round("value", 3).alias("duration"))


@query("V25_transport_error_rows", "SELECT o_orderkey, coalesce(n, 0) AS calls, CASE WHEN n IS NULL THEN 'transport_error' ELSE 'done' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def v25(spark, d):
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").join(done, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("calls"), F.when(F.col("n").isNull(), "transport_error").otherwise("done").alias("status"))


@query("V26_run_metadata", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing")
def v26(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count("known").alias("labelled"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("V27_health_roll_up", "SELECT count(*) AS documents, count(DISTINCT label) AS indexed, CASE WHEN count(*) = 0 OR count(DISTINCT label) > 0 THEN 'ok' ELSE 'degraded' END AS status FROM embeddings")
def v27(spark, d):
    n, k = F.count(F.lit(1)), F.count_distinct("label")
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(n.alias("documents"), k.alias("indexed"), V.health(k > 0, n).alias("status"))


@query("V28_tolerant_count_map", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def v28(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("J5_citation_validation", "SELECT l_orderkey, count(*) FILTER (WHERE p_partkey IS NOT NULL) AS kept, count(*) FILTER (WHERE p_partkey IS NULL) AS dropped FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY 1")
def j5(spark, d):
    seen = spark.read.parquet(f"{d}/part.parquet").where("p_size <= 25").select("p_partkey")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey").join(seen, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy("l_orderkey").agg(F.count("p_partkey").alias("kept"), F.count_if(F.col("p_partkey").isNull()).alias("dropped"))


@query("J6_truth_chain", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_name, s_name, 'none') AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def j6(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size > 20").select("p_partkey", "p_name")
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("p_name", "s_name", F.lit("none")).alias("name"))


@query("J7_page_range_cover", _ev("SELECT DISTINCT t.question FROM tg t JOIN res r ON r.question = t.question AND t.page BETWEEN r.page AND r.page + 2"))
def j7(spark, d):
    targets, r, parts = asked(spark, d)
    t = dealt(targets, parts, "question").select(F.col("question").alias("q"), F.col("page").alias("p"))
    return t.join(r, (t["q"] == r["question"]) & t["p"].between(r["page"], r["page"] + 2), "left_semi").select(F.col("q").alias("question")).distinct()


@query("J15_audit_verdicts", "SELECT coalesce(d.doc_id, l.doc_id + 5) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'stray' WHEN l.doc_id IS NULL THEN 'unaudited' ELSE 'audited' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id + 5")
def j15(spark, d):
    l5 = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") + 5).alias("l_id"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(l5, F.col("doc_id") == F.col("l_id"), "full")
    state = F.when(F.col("doc_id").isNull(), "stray").when(F.col("l_id").isNull(), "unaudited").otherwise("audited")
    return rows.select(F.coalesce("doc_id", "l_id").alias("doc_id"), state.alias("state"))


_DELTA = "WITH a AS (SELECT lang AS metric, count(*) AS n FROM documents WHERE n_chars > 3000 GROUP BY 1), b AS (SELECT lang AS metric, count(*) AS n FROM documents WHERE n_chars < 300 OR lang = 'en' GROUP BY 1)"


def _delta(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    a = rows.where("n_chars > 3000").groupBy(F.col("lang").alias("metric")).agg(F.count(F.lit(1)).alias("before"))
    b = rows.where("n_chars < 300 or lang = 'en'").groupBy(F.col("lang").alias("metric")).agg(F.count(F.lit(1)).alias("now"))
    return a.join(b, "metric", "full")


@query("J17_metric_delta", _DELTA + " SELECT metric, a.n AS before, b.n AS now, b.n - a.n AS delta FROM a FULL JOIN b USING (metric)")
def j17(spark, d):
    return _delta(spark, d).select("metric", "before", "now", (F.col("now") - F.col("before")).alias("delta"))


@query("K11_comparison_report", _DELTA + " SELECT metric || ': ' || coalesce(a.n::VARCHAR, '-') || ' -> ' || coalesce(b.n::VARCHAR, '-') AS line FROM a FULL JOIN b USING (metric)")
def k11(spark, d):
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return _delta(spark, d).select(F.concat("metric", F.lit(": "), show("before"), F.lit(" -> "), show("now")).alias("line"))


@query("S15_question_reader", as_int("idx", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS idx, length(text) AS chars FROM benchmark WHERE text IS NOT NULL AND trim(text) <> ''"))
def s15(spark, d):
    """The stable index of each question, numbered by blocks of ids."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null and trim(text) <> ''")
    numbered = prefix_sums(rows, F.floor(F.col("item_id") / 1000), ["item_id"], F.lit(1), "idx")
    return numbered.select("item_id", F.col("idx").cast("int").alias("idx"), F.length("text").cast("long").alias("chars"))


@query("S16_probe_targets", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN [item_id % 9] ELSE [item_id % 5, item_id % 7] END AS pages FROM benchmark")
def s16(spark, d):
    k = F.col("item_id")
    explicit, legacy = F.when(k % 2 == 0, F.array(k % 9)), F.transform(F.array(k % 5, k % 7), lambda p: p)
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.coalesce(explicit, legacy).alias("pages"))


@query("S17_verdict_map", "SELECT event_id, json_extract_string(props, '$.k') AS verdict FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s17(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "verdict"))
    return rows.where("key = 'k' and verdict is not null").select("event_id", "verdict")


@query("S19_truth_map_last_wins", "SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10000000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def s19(spark, d):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_orderkey"), F.desc("l_suppkey"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("turn", F.row_number().over(w))
    return rows.where("turn = 1").select("l_partkey", "l_suppkey")


@query("S20_index_fingerprint", "SELECT count(*) AS chunks, count(DISTINCT label) AS documents, max(len(embedding))::INT AS dimension FROM embeddings")
def s20(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("label").alias("documents"), F.max(F.size("embedding")).alias("dimension"))


@query("T16_failure_message", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'has_evidence' WHEN bool_and(event_type = 'error') THEN 'all_failed' ELSE 'none' END AS message FROM events GROUP BY 1")
def t16(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("has"), F.bool_and(F.col("event_type") == "error").alias("failed"))
    return rows.select("user_id", F.when(F.col("has"), "has_evidence").when(F.col("failed"), "all_failed").otherwise("none").alias("message"))


@query("X7_absorb_observation", "SELECT user_id, bool_or(event_type = 'view') AS searched, bool_or(event_type = 'click') AS read, list_sort(list_distinct(list(event_type))) AS observed FROM events GROUP BY 1")
def x7(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("searched"), F.bool_or(F.col("event_type") == "click").alias("read"), F.array_sort(F.collect_set("event_type")).alias("observed"))


@query("X9_latest_stage", "SELECT user_id, arg_max(event_type, event_id) AS stage, max(event_id) AS at FROM events GROUP BY 1")
def x9(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("stage"), F.max("event_id").alias("at"))


@query("X11_trace_digest", "SELECT user_id, string_agg(event_type || left(coalesce(props, ''), 500), ';' ORDER BY event_id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 20 GROUP BY 1")
def x11(spark, d):
    """The last 20 steps of each turn, arguments cut at 500 characters: the caps are the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("back", F.row_number().over(w)).where("back <= 20")
    step = F.struct("event_id", F.concat("event_type", F.substring(F.coalesce("props", F.lit("")), 1, 500)).alias("s"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]), ";").alias("digest"))


@query("X12_turn_failure_record", "SELECT event_id, 'failed: ' || event_type AS warning, true AS refused FROM events WHERE event_type = 'error'")
def x12(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select("event_id", F.concat(F.lit("failed: "), "event_type").alias("warning"), F.lit(True).alias("refused"))
