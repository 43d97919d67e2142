"""State queries: sources are collections, toxic labels disable documents, conversations are sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import as_int, query
from ..operators import state as S
from ..operators.cascade import ForeignKey
from ..operators.cascade import delete as cascade_delete


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars")


def disabled(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id")


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", "text")


def by_session():
    return Window.partitionBy("session_id").orderBy("id")


@query("J1_collection_counts", "SELECT n.n_name AS collection, count(c.c_custkey) AS members FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def j1(spark, d):
    n, c = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy(F.col("n_name").alias("collection")).agg(F.count("c_custkey").alias("members"))


@query("J2_allowed_documents", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > (SELECT count(*) FROM documents) / 20.0 - 1)")
def j2(spark, d):
    rows = docs(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    large = rows.groupBy("source").count().join(F.broadcast(total)).where(F.col("count") > F.col("total") / 20.0 - 1)
    return rows.join(large, "source", "left_semi").select("doc_id", "source")


@query("J3_scope_without_disabled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j3(spark, d):
    return docs(spark, d).join(disabled(spark, d), "doc_id", "left_anti").select("doc_id")


@query("U2_scope_difference", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def u2(spark, d):
    return docs(spark, d).select("doc_id").subtract(disabled(spark, d))


@query("U1_scope_union", "SELECT doc_id FROM documents WHERE source = 'src0' UNION SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE quality = 0")
def u1(spark, d):
    rows = docs(spark, d)
    low = spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").select("doc_id")
    return rows.where("source = 'src0'").select("doc_id").union(rows.where("lang = 'de'").select("doc_id")).union(low).distinct()


@query("U3_scope_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u3(spark, d):
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    return docs(spark, d).where("lang = 'en'").select("doc_id").intersect(good)


@query("U4_ordered_dedupe", "SELECT session_id, string_agg(role, ',' ORDER BY first_id) AS roles FROM (SELECT conv_id AS session_id, role, min(turn) AS first_id FROM conversations GROUP BY 1, 2) GROUP BY 1")
def u4(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "role"))), lambda s: s["role"])
    return messages(spark, d).groupBy("session_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query("U5_union_all_files", "SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'benchmark' AS kind, text FROM benchmark UNION ALL SELECT 'conversation', text FROM conversations) GROUP BY 1")
def u5(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.lit("benchmark").alias("kind"), "text")
    rows = b.unionByName(messages(spark, d).select(F.lit("conversation").alias("kind"), "text"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("U6_missing_documents", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u6(spark, d):
    return docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left_anti").select("doc_id").distinct()


@query("S21_collection_scope_read", "SELECT source AS collection_id, list_sort(list(doc_id)) AS document_ids FROM documents GROUP BY 1")
def s21(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("collection_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("document_ids"))


@query("S22_registry_names", "SELECT doc_id, coalesce(lang || '-' || doc_id || '.txt', 'unknown') AS name FROM documents")
def s22(spark, d):
    return docs(spark, d).select("doc_id", F.coalesce(F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("unknown")).alias("name"))


@query("J18_page_contains", "SELECT page_id, count(*) AS hits FROM (SELECT page_id, page_id % 7 AS page, [page_id % 5, page_id % 3] AS pages FROM pages) WHERE list_contains(pages, 2) OR page = 2 GROUP BY 1")
def j18(spark, d):
    k = F.col("page_id")
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", (k % 7).alias("page"), F.array(k % 5, k % 3).alias("pages"))
    return rows.where(F.array_contains("pages", F.lit(2).cast("long")) | (F.col("page") == 2)).groupBy("page_id").agg(F.count(F.lit(1)).alias("hits"))


@query("J19_name_variants", "WITH s AS (SELECT s_suppkey, lower(s_name) AS a, replace(lower(s_name), 'supplier#', '') AS b FROM supplier), c AS (SELECT c_custkey, lower(c_name) AS a, replace(lower(c_name), 'customer#', '') AS b FROM customer) SELECT s_suppkey, count(DISTINCT c_custkey) AS matches FROM s JOIN c ON s.a = c.a OR s.b = c.b GROUP BY 1")
def j19(spark, d):
    """Exploded variants meet by equality, so the overlap join is a hash join."""
    variants = lambda t, k, n, w: spark.read.parquet(f"{d}/{t}.parquet").select(k, F.explode(F.array(F.lower(n), F.replace(F.lower(n), F.lit(w), F.lit("")))).alias("variant"))
    rows = variants("supplier", "s_suppkey", "s_name", "supplier#").join(variants("customer", "c_custkey", "c_name", "customer#"), "variant")
    return rows.groupBy("s_suppkey").agg(F.count_distinct("c_custkey").alias("matches"))


@query("J21_filename_fallback", "WITH n AS (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn FROM documents d) SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE rn <= 6) AS hint, greatest(count(*) - 6, 0) AS remaining FROM n GROUP BY 1")
def j21(spark, d):
    """The first six ids come by rank, so that no list of a whole source is made."""
    ranked = docs(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 6")
    hints = ranked.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("hint"))
    counts = docs(spark, d).groupBy("source").agg(F.greatest(F.count(F.lit(1)) - 6, F.lit(0)).alias("remaining"))
    return hints.join(counts, hints["source"].eqNullSafe(counts["source"])).select(hints["source"], "hint", "remaining")


@query("J22_tool_listing", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'slide ' || p WHEN 1 THEN 'sheet ' || p WHEN 2 THEN '§' || p ELSE 'p' || p || CASE WHEN doc_id % 8 = 3 THEN '-' || (p + 1) ELSE '' END END AS label, CASE doc_id % 4 WHEN 0 THEN 'slides' WHEN 1 THEN 'sheets' WHEN 2 THEN 'sections' ELSE 'pages' END AS unit FROM (SELECT *, n_chars // 1000 + 1 AS p FROM documents) WHERE source IN ('src1', 'src2')")
def j22(spark, d):
    picked = spark.createDataFrame([("src1",), ("src2",)], "source string")
    rows = docs(spark, d).join(F.broadcast(picked), "source", "left_semi")
    kind = F.element_at(F.array(*map(F.lit, ("slide", "sheet", "section", "page"))), (F.col("doc_id") % 4 + 1).cast("int"))
    page = F.floor(F.col("n_chars") / 1000) + 1
    last = F.when(F.col("doc_id") % 8 == 3, page + 1)
    return rows.select("doc_id", S.page_label(page, last, kind).alias("label"), S.count_unit(kind).alias("unit"))

@query("J23_library_roll_up", "SELECT d.source, count(*) AS documents, count(*) FILTER (WHERE l.toxic = 1) AS disabled, count(*) FILTER (WHERE l.quality = 0) AS flagged, count(*) FILTER (WHERE l.doc_id IS NULL) AS unknown FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def j23(spark, d):
    rows = docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumn("known", F.lit(True)), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("toxic") == 1).alias("disabled"), F.count_if(F.col("quality") == 0).alias("flagged"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query("J16_quality_join", "SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'ok' WHEN 0 THEN 'degraded' END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j16(spark, d):
    rows = docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "degraded").alias("quality"))


@query("L2_sessions_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20")
def l2(spark, d):
    """A page of at most 100 rows is the feature."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(min(max(500, S.PAGE_MIN), S.PAGE_MAX))


@query("L3_newest_then_ascending", as_int("place", "SELECT conv_id AS session_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3"))
def l3(spark, d):
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    rows = messages(spark, d).withColumn("back", F.row_number().over(newest)).where("back <= 3")
    return rows.select("session_id", "id", F.row_number().over(by_session()).alias("place"))


@query("L4_keyset_pagination", "WITH k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn < 4) SELECT conv_id AS session_id, turn AS id, n > 2 AS has_more FROM k WHERE r <= 2")
def l4(spark, d):
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    rows = messages(spark, d).where("id < 4").withColumn("r", F.row_number().over(newest))
    rows = rows.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy("session_id")) > 2)
    return rows.where("r <= 2").select("session_id", "id", "has_more")


@query("L5_sentinel_sort", as_int("place", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(nullif(doc_id % 5, 0), 1000000000), doc_id) AS place FROM documents"))
def l5(spark, d):
    key = F.coalesce(F.nullif(F.col("doc_id") % 5, F.lit(0)), F.lit(10**9))
    return docs(spark, d).select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(key, "doc_id")).alias("place"))


@query("L6_page_slice", "SELECT doc_id, substring(coalesce(text, ''), 101, 6000) AS page, greatest(0, length(coalesce(text, '')) - 6100) AS remaining FROM documents")
def l6(spark, d):
    """A read of 6,000 characters from an offset is the feature."""
    t = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", F.substring(t, 101, 6000).alias("page"), F.greatest(F.lit(0), F.length(t) - 6100).cast("long").alias("remaining"))


@query("L7_limit_after_dedupe", "SELECT source, array_to_string(list_sort(list_distinct(list(lang)))[1:3], ',') AS langs FROM documents GROUP BY 1")
def l7(spark, d):
    return docs(spark, d).groupBy("source").agg(F.array_join(F.slice(F.array_sort(F.collect_set("lang")), 1, 3), ",").alias("langs"))


@query("L8_row_selection", "SELECT item_id FROM benchmark WHERE item_id IN (1, 3, 5, 7, 11) OR item_id % 4 = 2")
def l8(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").where(F.col("item_id").isin(1, 3, 5, 7, 11) | (F.col("item_id") % 4 == 2)).select("item_id")


@query("A17_message_counts", "SELECT conv_id AS session_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY 1")
def a17(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("A16_ordered_string_agg", "SELECT conv_id AS session_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS shape FROM conversations GROUP BY 1")
def a16(spark, d):
    rows = messages(spark, d).select("session_id", F.struct("id", F.concat_ws(":", "role", F.length("text")).alias("s")).alias("r"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["s"]), " ").alias("shape"))


_EST = "(length(text) - length(regexp_replace(text, '[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3000-\\u303f\\uff00-\\uffef]', '', 'g')) + length(regexp_replace(text, '[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3000-\\u303f\\uff00-\\uffef]', '', 'g')) // 4)".replace("\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3000-\\u303f\\uff00-\\uffef", "㐀-䶿一-鿿豈-﫿　-〿＀-￯")


@query("T11_token_estimate", f"SELECT conv_id AS session_id, turn AS id, {_EST} AS tokens FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '中文，测试。' ELSE '' END AS text FROM conversations)")
def t11(spark, d):
    text = F.concat("text", F.when(F.col("id") % 2 == 0, F.lit("中文，测试。")).otherwise(F.lit("")))
    return messages(spark, d).select("session_id", "id", S.estimate_tokens(text).cast("long").alias("tokens"))


_W10 = f"""m AS (SELECT conv_id AS session_id, turn AS id, {_EST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
u AS (SELECT *, sum(CASE WHEN rn > 2 THEN cost ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM m)"""


@query("W10_newest_first_budget", f"WITH {_W10} SELECT session_id, id FROM u WHERE rn <= 2 OR used <= 120")
def w10(spark, d):
    rows = messages(spark, d).withColumn("cost", S.estimate_tokens(F.col("text")))
    return S.newest_within(rows, "session_id", "id", "cost", 120, 2).select("session_id", "id")


@query("V22_history_budget", f"WITH {_W10}, b AS (SELECT session_id, greatest(4000, least(24000, floor((8000 + 1000 * (session_id % 90)) * 0.3)))::BIGINT AS budget FROM m GROUP BY 1) SELECT b.session_id, b.budget, count(*) AS kept FROM b JOIN u USING (session_id) WHERE rn <= 2 OR used <= 60 GROUP BY 1, 2")
def v22(spark, d):
    rows = messages(spark, d).withColumn("cost", S.estimate_tokens(F.col("text")))
    kept = S.newest_within(rows, "session_id", "id", "cost", 60, 2)
    context = 8000 + 1000 * (F.col("session_id") % 90)
    return kept.groupBy("session_id", S.history_budget(context).cast("long").alias("budget")).agg(F.count(F.lit(1)).alias("kept"))


@query("W14_every_nth_user_turn", "SELECT conv_id AS session_id, turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n % 2 = 0")
def w14(spark, d):
    rows = messages(spark, d).where("role = 'user'").withColumn("n", F.row_number().over(by_session()))
    return rows.where("n % 2 = 0").select("session_id", "id")


@query("W15_empty_search_streak", "WITH e AS (SELECT *, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hit FROM events) SELECT e.event_id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.event_id <= e.event_id AND x.event_id > coalesce(e.hit, -1)) AS streak FROM e")
def w15(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.col("event_type") == "click").alias("hit"))
    return S.streaks(rows, "user_id", "event_id", "hit").select("event_id", "streak")


@query("W16_round_ledger", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS calls, floor(epoch(ts - min(ts) OVER (PARTITION BY user_id, date_trunc('day', ts))))::BIGINT AS offset_s FROM events")
def w16(spark, d):
    turn = Window.partitionBy("user_id", F.date_trunc("day", "ts"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{d}/events.parquet")
    seconds = F.floor((micros - F.min(micros).over(turn)) / 1000000)
    return rows.select("user_id", "event_id", F.count(F.lit(1)).over(turn).alias("calls"), seconds.cast("long").alias("offset_s"))


@query("W17_summary_boundary", "SELECT conv_id AS session_id, max(turn) AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn > 3 GROUP BY 1")
def w17(spark, d):
    rows = messages(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id"))))
    return rows.where("rn > 3").groupBy("session_id").agg(F.max("id").alias("boundary"))


@query("W18_summary_due", "SELECT conv_id AS session_id, count(*) > 4 AND min(turn) - 1 >= 0 AS due FROM conversations GROUP BY 1")
def w18(spark, d):
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    rows = messages(spark, d).withColumn("rn", F.row_number().over(newest)).where("rn <= 200")
    return rows.groupBy("session_id").agg(((F.max("rn") > 4) & (F.min("id") - 1 >= 0)).alias("due"))


@query("W19_prompt_pressure", f"SELECT conv_id AS session_id, sum({_EST})::BIGINT AS tokens, sum({_EST}) > 0.85 * 1000 AS pressed FROM conversations GROUP BY 1")
def w19(spark, d):
    total = F.sum(S.estimate_tokens(F.col("text"))).cast("long")
    return messages(spark, d).groupBy("session_id").agg(total.alias("tokens"), (total > S.PRESSURE * 1000).alias("pressed"))


@query("D1_insert_if_absent", "SELECT n_name AS name FROM nation UNION SELECT DISTINCT c_mktsegment FROM customer")
def d1(spark, d):
    old = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"))
    new = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("name")).where("name is not null")
    return S.insert_absent(old, new, ["name"])


@query("D2_insert_or_ignore_pairs", "SELECT DISTINCT source, lang FROM documents UNION SELECT DISTINCT 'src0', role FROM conversations")
def d2(spark, d):
    old = docs(spark, d).select("source", "lang").distinct()
    new = messages(spark, d).select(F.lit("src0").alias("source"), F.col("role").alias("lang"))
    return S.insert_absent(old, new, ["source", "lang"])


@query("D3_partial_upsert", "SELECT coalesce(l.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, l.quality) AS quality, l.toxic AS toxic FROM labels l FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 END::INT AS quality FROM documents WHERE doc_id % 2 = 0) n ON l.doc_id = n.doc_id")
def d3(spark, d):
    old = spark.read.parquet(f"{d}/labels.parquet")
    new = docs(spark, d).where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(1)).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return S.upsert(old, new, ["doc_id"], ["quality", "toxic"])


@query("D4_cascade_delete", "SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)) AS orders_left, (SELECT count(*) FROM customer WHERE c_nationkey <> 7) AS customers_left, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS customers_gone")
def d4(spark, d):
    c, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    stay = c.where("c_nationkey <> 7")
    left = o.join(stay, o["o_custkey"] == stay["c_custkey"], "left_semi").agg(F.count(F.lit(1)).alias("orders_left"))
    counts = c.agg(F.count_if(F.col("c_nationkey") != 7).alias("customers_left"), F.count_if(F.col("c_nationkey") == 7).alias("customers_gone"))
    return left.crossJoin(counts)


_GRAPH = """WITH n AS (SELECT * FROM nation WHERE n_nationkey IN (7, 8)), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n))
SELECT "table", action, n, keys_left::BIGINT AS keys_left FROM (SELECT 'nation' AS "table", 'deleted' AS action, (SELECT count(*) FROM n) AS n, (SELECT sum(n_nationkey) FROM nation WHERE n_nationkey NOT IN (7, 8))::BIGINT AS keys_left
UNION ALL SELECT 'customer', 'deleted', (SELECT count(*) FROM c), (SELECT sum(c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c))
UNION ALL SELECT 'orders', 'deleted', (SELECT count(*) FROM o), (SELECT sum(o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o))
UNION ALL SELECT 'lineitem', 'deleted', (SELECT count(*) FROM l), (SELECT sum(l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
UNION ALL SELECT 'supplier', 'set_null', (SELECT count(*) FROM s), (SELECT sum(s_nationkey) FROM supplier WHERE s_nationkey NOT IN (7, 8)))"""


@query("D4_cascade_graph", _GRAPH)
def d4_graph(spark, d):
    """Two nations go: their customers, orders and order lines with them, their suppliers lose the nation; what
    was touched, and the sum of the keys that are left."""
    names = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in names}
    edges = [ForeignKey("customer", "c_nationkey", "nation"), ForeignKey("orders", "o_custkey", "customer"), ForeignKey("lineitem", "l_orderkey", "orders"), ForeignKey("supplier", "s_nationkey", "nation", "set_null")]
    done = cascade_delete(tables, names, "nation", tables["nation"].where("n_nationkey in (7, 8)").select("n_nationkey"), edges)
    sums = [done.tables[t].agg(F.lit(t).alias("table"), F.sum("s_nationkey" if t == "supplier" else key).cast("long").alias("keys_left")) for t, key in names.items()]
    return done.impact.join(reduce(DataFrame.unionByName, sums), "table").select("table", "action", F.col("rows").alias("n"), "keys_left")


@query("D5_rename_conflict", "SELECT n_nationkey, CASE WHEN upper(r_name) IN (SELECT n_name FROM nation) THEN 'conflict' ELSE r_name END AS outcome FROM nation JOIN region ON n_regionkey = r_regionkey")
def d5(spark, d):
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    taken = n.select(F.col("n_name").alias("taken")).distinct()
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(taken, F.upper("r_name") == F.col("taken"), "left")
    return rows.select("n_nationkey", F.when(F.col("taken").isNotNull(), "conflict").otherwise(F.col("r_name")).alias("outcome"))


@query("D6_guarded_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 IN (0, 1) OR o_orderstatus = 'P' AND o_orderkey % 3 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'F' ELSE 'X' END ELSE o_orderstatus END AS status FROM orders")
def d6(spark, d):
    """Open orders may be filled or cancelled, pending ones cancelled only."""
    wanted = F.element_at(F.array(F.lit("F"), F.lit("X"), F.lit("O")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.moved(F.col("o_orderstatus"), wanted, {"O": ("F", "X"), "P": ("X",)}).alias("status"))


@query("D7_compaction", "SELECT conv_id AS session_id, turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def d7(spark, d):
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    rows = messages(spark, d).withColumn("rn", rn)
    boundary = F.max(F.when(F.col("rn") > 3, F.col("id"))).over(Window.partitionBy("session_id"))
    return rows.withColumn("boundary", boundary).where("boundary is null or id > boundary").select("session_id", "id")


@query("D8_failure_breaker", "WITH e AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events) SELECT user_id, max(n) AS worst, max(n) >= 3 AS tripped FROM (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, ok ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM e) GROUP BY 1")
def d8(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.col("event_type") != "error").alias("hit"))
    return S.streaks(rows, "user_id", "event_id", "hit").groupBy("user_id").agg(F.max("streak").alias("worst"), (F.max("streak") >= S.BREAKER).alias("tripped"))


@query("D10_scope_lock", "WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS locked FROM events GROUP BY 1) SELECT e.event_id, f.locked, e.event_type <> f.locked AS mismatch FROM events e JOIN f USING (user_id)")
def d10(spark, d):
    first = F.first("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", first.alias("locked"), (F.col("event_type") != first).alias("mismatch"))


@query("D12_memory_edit", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'edited' ELSE event_type END AS value FROM events WHERE event_id % 5 <> 0")
def d12(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("value"))
    edits = rows.where("event_id % 3 = 0").select("event_id", F.lit("edited").alias("value"))
    deleted = rows.where("event_id % 5 = 0").select("event_id")
    return S.upsert(rows, edits, ["event_id"], ["value"]).join(deleted, "event_id", "left_anti")


@query("D13_registry_meta_update", "SELECT doc_id, left(coalesce(CASE WHEN doc_id % 3 = 0 THEN repeat(lang, 80) END, source), 120) AS alias, doc_id % 7 <> 0 AS enabled FROM documents")
def d13(spark, d):
    alias = F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.repeat("lang", F.lit(80))), F.col("source"))
    return docs(spark, d).select("doc_id", F.substring(alias, 1, S.KEY_CHARS).alias("alias"), (F.col("doc_id") % 7 != 0).alias("enabled"))


@query("D14_pending_note", "SELECT conv_id AS session_id, turn AS id, left(role, 120) AS key, left(text, 500) AS value FROM conversations WHERE role IN ('user', 'system')")
def d14(spark, d):
    rows = messages(spark, d).where(F.col("role").isin("user", "system"))
    return rows.select("session_id", "id", F.substring("role", 1, S.KEY_CHARS).alias("key"), F.substring("text", 1, S.VALUE_CHARS).alias("value"))


@query("D15_confirm_subset", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d15(spark, d):
    pending = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'")
    ids = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending.join(ids, "o_orderkey", "left_semi").select("o_orderkey")


@query("D9_candidate_promotion", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'preferences' WHEN event_type = 'purchase' AND user_id % 2 = 0 AND event_id % 4 IN (0, 1) THEN 'progress' WHEN event_type = 'signup' THEN 'profile' END AS target,
CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND user_id % 2 = 0 AND event_id % 4 IN (0, 1)) THEN ['next_step', 'last_focus', 'major', 'other'][event_id % 4 + 1] WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 2 THEN 'major' ELSE 'goal' END END AS field FROM events WHERE event_id % 5 <> 0""")
def d9(spark, d):
    """Event types stand for kinds; every fifth candidate is not pending, odd users have no collection."""
    kind = F.when(F.col("event_type") == "click", "preference").when(F.col("event_type") == "purchase", "progress").when(F.col("event_type") == "signup", "profile").otherwise("note")
    key = F.element_at(F.array(*map(F.lit, ("next_step", "last_focus", "major", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", kind.alias("kind"), key.alias("key"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("collection_id"), F.when(F.col("event_id") % 5 == 0, "rejected").otherwise("pending").alias("status"))
    return S.promoted(rows).select("event_id", "target", "field")


@query("D16_task_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND l.n IS NULL THEN 'not_found' WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'failed:urgent' WHEN o_orderpriority LIKE '%LOW%' THEN 'failed:low' ELSE 'failed:unknown' END WHEN o_orderstatus = 'F' THEN 'success' ELSE 'pending' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def d16(spark, d):
    """The ledger knows orders with lines; priorities are the messages of failures."""
    ledger = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("known", F.lit(True))
    rows = spark.read.parquet(f"{d}/orders.parquet").join(ledger, "o_orderkey", "left")
    state = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "F", "success").otherwise("pending")
    return rows.select("o_orderkey", S.task_status(F.col("known"), state, F.col("o_orderpriority"), {"urgent": "urgent", "low": "low"}).alias("status"))


@query("D17_retry_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'queued' WHEN o_orderkey % 3 = 1 AND o_orderstatus IN ('F', 'O') THEN 'replaced' WHEN o_orderkey % 3 = 2 AND o_orderstatus IN ('F', 'O', 'P') THEN 'deleted' ELSE o_orderstatus END AS status FROM orders")
def d17(spark, d):
    """Only failed (F) ones are retried, busy (P) ones are not replaced, all can be deleted."""
    wanted = F.element_at(F.array(*map(F.lit, ("queued", "replaced", "deleted"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rules = {"F": ("queued", "replaced", "deleted"), "O": ("replaced", "deleted"), "P": ("deleted",)}
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.moved(F.col("o_orderstatus"), wanted, rules).alias("status"))


@query("V20_collection_digest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT source, count(*) AS n, max(CASE WHEN rn = 1 THEN left(text, 140) END) AS opening FROM r GROUP BY 1")
def v20(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring("text", 1, 140), "doc_id").alias("opening"))


@query("V21_memory_digest", "SELECT user_id, left(string_agg(event_type || '=' || n, '; ' ORDER BY event_type), 600) AS digest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def v21(spark, d):
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").count()
    rows = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "count"))).alias("parts"))
    return rows.select("user_id", F.substring(F.array_join("parts", "; "), 1, 600).alias("digest"))


@query("V29_scope_declaration", "SELECT lang, string_agg(source, ', ' ORDER BY source) AS scope FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def v29(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("scope"))


@query("K10_transcript_export", "WITH k AS (SELECT conv_id, turn, role, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id AS session_id, string_agg(CASE role WHEN 'user' THEN '## ' || q || '. ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS body FROM k GROUP BY 1")
def k10(spark, d):
    rows = messages(spark, d).where(F.col("role").isin("user", "assistant"))
    number = F.count_if(F.col("role") == "user").over(by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = F.when(F.col("role") == "user", F.concat(F.lit("## "), number.cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    rows = rows.select("session_id", F.struct("id", line.alias("line")).alias("r"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n\n").alias("body"))


@query("T12_transcript_format", "WITH k AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS line FROM conversations WHERE role IN ('user', 'assistant')), u AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM k) SELECT conv_id AS session_id, turn AS id, CASE WHEN used <= 600 THEN line ELSE left(line, (600 - (used - length(line)))::BIGINT) END AS line FROM u WHERE used <= 600 OR 600 - (used - length(line)) >= 80".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r"))
def t12(spark, d):
    line = F.concat_ws(": ", "role", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    rows = messages(spark, d).where(F.col("role").isin("user", "assistant")).select("session_id", "id", line.alias("line"))
    used = F.sum(F.length("line")).over(by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("left", 600 - (used - F.length("line")))
    whole = F.length("line") <= F.col("left")
    return rows.where(whole | (F.col("left") >= 80)).select("session_id", "id", F.when(whole, F.col("line")).otherwise(F.left("line", F.col("left").cast("int"))).alias("line"))


@query("T13_summary_cleanup", "SELECT item_id, CASE WHEN length(t) > 200 THEN left(t, 199) || '…' ELSE t END AS summary FROM (SELECT item_id, trim(text) AS t FROM benchmark)")
def t13(spark, d):
    """The text comes fenced; the cap is 200 characters here."""
    fenced = F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))
    t = F.trim(F.regexp_replace(fenced, r"^```[a-z]*\n|\n```$", ""))
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 199), F.lit("…"))).otherwise(t).alias("summary"))


@query("T14_requested_scope", "SELECT e.user_id, list_sort(list_distinct(list(e.value::BIGINT % 30))) AS asked, count(*) FILTER (WHERE n.n_nationkey IS NULL) AS unknown FROM events e LEFT JOIN nation n ON n.n_nationkey = e.value::BIGINT % 30 GROUP BY 1".replace("e.value::BIGINT", "floor(e.value)::BIGINT"))
def t14(spark, d):
    known = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", (F.floor("value") % 30).alias("asked")).join(F.broadcast(known), F.col("asked") == F.col("k"), "left")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_set("asked")).alias("asked"), F.count_if(F.col("k").isNull()).alias("unknown"))
