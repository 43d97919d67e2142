"""Routing queries: questions are benchmark passages and turns, with literal CJK endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import route as T
from ..operators.settings import with_violations

ENDINGS = ("", "？注意力机制是什么，编码器以及解码器分别怎么训练", "训练集在第3节", "多头注意力和数据集", "hello")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, q): each turn's text with one of five endings; short ones are the ending alone."""
    k = F.col("turn") + F.col("conv_id")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (k % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    return rows.select("conv_id", "turn", F.when(k % 2 == 0, F.concat("text", ending)).otherwise(ending).alias("q"))


QS = "qs AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 2 = 0 THEN text || e ELSE e END AS q FROM (SELECT *, ['', '？注意力机制是什么，编码器以及解码器分别怎么训练', '训练集在第3节', '多头注意力和数据集', 'hello'][(turn + conv_id) % 5 + 1] AS e FROM conversations WHERE text IS NOT NULL)), cl AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(q, '[？?；;。!！]|，|、|并且|以及|还有|同时|分别', chr(1), 'g'), chr(1)), lambda c: trim(c, ' 　，。？?')), lambda c: length(c) >= 4 AND c <> q) AS kept FROM qs), c2 AS (SELECT *, CASE WHEN len(kept) >= 2 THEN kept[1:4] ELSE [] END AS clauses FROM cl)"


def _qs(body: str) -> str:
    return f"WITH {QS}{body}"


@query("T1_clause_split", _qs(" SELECT conv_id, turn, array_to_string(clauses, '|') AS clauses FROM c2"))
def t1(spark, d):
    return questions(spark, d).select("conv_id", "turn", F.array_join(T.clauses(F.col("q")), "|").alias("clauses"))


_WANTS = "(len(clauses) >= 2 OR regexp_matches(q, '[0-9]') OR length(trim(q)) >= 40)"


@query("T2_route_signals", _qs(f" SELECT conv_id, turn, regexp_matches(q, '[0-9]') AS has_numbers, length(trim(q)) AS chars, {_WANTS} AS wants_plan FROM c2"))
def t2(spark, d):
    q = F.col("q")
    return questions(spark, d).select("conv_id", "turn", q.rlike(r"\d").alias("has_numbers"), F.length(F.trim(q)).cast("long").alias("chars"), T.wants_plan(q, F.lit(0)).alias("wants_plan"))


@query("T3_rule_decision", _qs(f" SELECT conv_id, turn, CASE WHEN {_WANTS} THEN 'planned' ELSE 'direct' END AS track, CASE WHEN length(q) = strlen(q) THEN q ELSE '' END AS english FROM c2"))
def t3(spark, d):
    q = F.col("q")
    return questions(spark, d).select("conv_id", "turn", F.when(T.wants_plan(q, F.lit(0)), "planned").otherwise("direct").alias("track"), T.english(q).alias("english"))


_RATIO = "(length(s) - length(regexp_replace(s, '[㐀-䶿一-鿿豈-﫿　-〿＀-￯]', '', 'g')))::DOUBLE / greatest(length(s), 1)"


@query("T4_cross_language_guard", _qs(f", r AS (SELECT *, regexp_replace(q, '[ \\t\\n\\r]', '', 'g') AS s FROM c2) SELECT conv_id, turn, round({_RATIO}, 6) AS ratio, CASE WHEN {_WANTS} OR ({_RATIO} >= 0.3 AND regexp_matches(q, '[0-9A-Za-z]')) THEN 'planned' ELSE 'direct' END AS track FROM r"))
def t4(spark, d):
    q = F.col("q")
    return questions(spark, d).select("conv_id", "turn", F.round(T.cjk_ratio(q), 6).alias("ratio"), T.track(q, F.lit(0)).alias("track"))


@query("T5_decision_modes", _qs(f", r AS (SELECT *, regexp_replace(q, '[ \\t\\n\\r]', '', 'g') AS s, ['auto', 'direct', 'planned'][turn % 3 + 1] AS mode FROM c2) SELECT conv_id, turn, mode, CASE WHEN mode <> 'auto' THEN mode WHEN {_WANTS} OR ({_RATIO} >= 0.3 AND regexp_matches(q, '[0-9A-Za-z]')) THEN 'planned' ELSE 'direct' END AS track, mode = 'auto' AS fallback FROM r"))
def t5(spark, d):
    """Forced modes pin the track; without a model, auto falls back to the rules."""
    q, mode = F.col("q"), F.element_at(F.array(F.lit("auto"), F.lit("direct"), F.lit("planned")), (F.col("turn") % 3 + 1).cast("int"))
    return questions(spark, d).select("conv_id", "turn", mode.alias("mode"), F.when(mode != "auto", mode).otherwise(T.track(q, F.lit(0))).alias("track"), (mode == "auto").alias("fallback"))


@query("T6_dense_texts", _qs(", u AS (SELECT conv_id, turn, unnest(list_concat(list_concat([q], clauses), [CASE WHEN length(q) = strlen(q) THEN q ELSE '' END])) AS t FROM c2) SELECT conv_id, turn, count(DISTINCT trim(t)) AS n FROM u WHERE trim(t) <> '' GROUP BY 1, 2"))
def t6(spark, d):
    return questions(spark, d).select("conv_id", "turn", F.size(T.dense_texts(F.col("q"))).cast("long").alias("n")).where("n > 0")


_TERMS = ", t(source, target) AS (VALUES {}), h AS (SELECT conv_id, turn, target, max(length(source)) AS longest FROM qs JOIN t ON contains(q, source) GROUP BY 1, 2, 3)".format(", ".join(f"('{k}', '{v}')" for k, v in T.TERMS.items()))


def _matched(spark, d):
    rows = questions(spark, d).withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    return T.matched_terms(rows, "k", "q")


@query("T7_term_match", _qs(_TERMS + " SELECT conv_id || ':' || turn AS k, target FROM h"))
def t7(spark, d):
    return _matched(spark, d).select("k", "target")


@query("J11_theta_join_terms", _qs(_TERMS + " SELECT target, count(*) AS questions FROM h GROUP BY 1"))
def j11(spark, d):
    return _matched(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("questions"))


@query("T8_plan_parse", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || item_id || '|b' ELSE '1|2|3|4' END AS subqueries FROM benchmark")
def t8(spark, d):
    k = F.col("item_id")
    raw = F.when(k % 3 == 0, "no plan").when(k % 3 == 1, F.concat(F.lit('```json\n{"subqueries": ["a'), k.cast("string"), F.lit('", "b"]}\n```'))).otherwise('so {"subqueries": ["1", "2", "3", "4", "5"], "english_query": "x"} ok')
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_join(T.plan_of(raw)["subqueries"], "|").alias("subqueries"))


@query("T9_relatedness", _qs(""" SELECT conv_id, turn, NOT (length(trim(q)) <= 12 AND (lower(trim(q)) LIKE 'hi%' OR lower(trim(q)) LIKE 'hello%')) AND (contains(lower(q), 'ation') OR
 len(list_filter(['这篇','那篇','论文','文章','资料','文档','文献','第','节','章','作者','公式','表','图','页','摘要','引言','实验','结果','方法','指标','数据集','定义','定理','证明','模型','架构'], lambda x: contains(q, x))) > 0
 OR (length(trim(q)) >= 4 AND len(list_filter(['?','？','什么','如何','怎么','为什么','为何','多少','几','是否','区别','比较','解释','讲一下','说说'], lambda x: contains(q, x))) > 0)) AS related FROM qs"""))
def t9(spark, d):
    return questions(spark, d).select("conv_id", "turn", T.is_related(F.col("q"), F.lit(True), F.array(F.lit("Ation"))).alias("related"))


@query("T10_explicit_memory", _qs(" SELECT conv_id, turn, contains(q, '别忘了') OR regexp_matches(lower(q), 'remember (this|that)|keep (this|that) in mind|always (use|answer|reply)') AS asked FROM (SELECT conv_id, turn, q || CASE WHEN turn = 2 THEN ' 别忘了' ELSE '' END AS q FROM qs)"))
def t10(spark, d):
    q = F.concat("q", F.when(F.col("turn") == 2, F.lit(" 别忘了")).otherwise(F.lit("")))
    return questions(spark, d).select("conv_id", "turn", q.rlike(T.REMEMBER).alias("asked"))


@query("T15_settings_validation", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size - 5 < 1 THEN 'top_k' END, CASE WHEN p_size % 4 - 1 < 0 THEN 'quota_per_query' END, CASE WHEN p_retailprice / 1000 - 1 > 0.5 THEN 'score_floor_ratio' END, CASE WHEN p_size < 8 THEN 'rerank_max_length' END, CASE WHEN p_size % 3 = 0 THEN 'route_mode' END], lambda x: x IS NOT NULL), ',') AS violations FROM part")
def t15(spark, d):
    """Each part is a set of settings."""
    size = F.col("p_size")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", (size - 5).alias("top_k"), (size % 4 - 1).alias("quota_per_query"), (F.col("p_retailprice") / 1000 - 0.5).alias("score_floor_ratio"),
        size.alias("rerank_max_length"), F.when(size % 3 == 0, "fast").otherwise("auto").alias("route_mode"),
    )
    return with_violations(rows).select("p_partkey", F.array_join("violations", ",").alias("violations"))


@query("T17_call_signature", "SELECT o_orderkey, 'search:{\"a\":\"' || o_orderstatus || '\",\"b\":\"' || o_custkey || '\"}' AS signature FROM orders")
def t17(spark, d):
    args = F.concat(F.lit('{"b": "'), F.col("o_custkey").cast("string"), F.lit('", "a": "'), "o_orderstatus", F.lit('"}'))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.signature(F.lit("search"), args).alias("signature"))
