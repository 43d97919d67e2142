"""Event-stream queries: the events of a user and day are a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.cache import VersionedCache
from ..operators.retrieve import scripted_search
from ..streaming import turns as T
from ..streaming.summaries import due_sessions

KINDS = {"view": "tool_call", "click": "tool_result", "purchase": "answer_delta", "signup": "answer_reset", "error": "gate_block"}


def events(spark: SparkSession, d: str) -> DataFrame:
    """(turn_id, seq, event, data, round, call_index): users are turns; an answer delta's data is the last
    digit of its id, rounds and call indexes come from the id too."""
    kind = F.when(F.col("event_id") % 41 == 0, "turn_end").otherwise("turn_start")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    rows, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return rows.select(F.col("user_id").alias("turn_id"), k.alias("seq"), kind.alias("event"), (k % 10).cast("string").alias("data"), (k % 5).cast("int").alias("round"), (k % 2).cast("int").alias("call_index"))


EVT = "ev AS (SELECT user_id AS turn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' WHEN 'purchase' THEN 'answer_delta' WHEN 'signup' THEN 'answer_reset' WHEN 'error' THEN 'gate_block' ELSE CASE WHEN event_id % 41 = 0 THEN 'turn_end' ELSE 'turn_start' END END AS event, (event_id % 10)::VARCHAR AS data, (event_id % 5)::INT AS round, (event_id % 2)::INT AS call_index FROM events)"


@query("X1_turn_events", f"WITH {EVT} SELECT turn_id, event, count(*) AS n, min(seq) AS first, max(seq) AS last FROM ev GROUP BY 1, 2")
def x1(spark, d):
    return events(spark, d).groupBy("turn_id", "event").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("X2_frame_parser", f"WITH {EVT} SELECT turn_id, event, count(*) AS n FROM ev WHERE seq % 3 <> 0 GROUP BY 1, 2")
def x2(spark, d):
    """Every third frame is a comment; the others parse back to their events."""
    frame = F.when(F.col("seq") % 3 == 0, ": ping").otherwise(F.concat(F.lit("event: "), "event", F.lit('\ndata: {"d": '), "data", F.lit("}")))
    raw = events(spark, d).groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", frame.alias("f")))), lambda s: s["f"]), "\n\n").alias("raw"))
    rows = raw.select("turn_id", F.explode(T.frames(F.col("raw"))).alias("f"))
    return rows.groupBy("turn_id", F.col("f.event").alias("event")).agg(F.count(F.lit(1)).alias("n"))


@query("X3_turn_reducer", f"""WITH {EVT}, c AS (SELECT turn_id, max(seq) FILTER (WHERE event IN ('answer_reset', 'turn_end')) AS cut FROM ev GROUP BY 1),
k AS (SELECT a.turn_id, count(*) AS done FROM ev a WHERE a.event = 'tool_call' AND EXISTS (SELECT 1 FROM ev r WHERE r.turn_id = a.turn_id AND r.event = 'tool_result' AND r.round = a.round AND r.call_index = a.call_index AND r.seq > a.seq) GROUP BY 1)
SELECT turn_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE event = 'answer_delta' AND seq > coalesce(cut, -1)), '') AS answer, count(*) FILTER (WHERE event = 'tool_call')::INT AS calls, coalesce(any_value(done), 0)::INT AS results, count(*) FILTER (WHERE event = 'answer_reset')::INT AS resets,
count(*) FILTER (WHERE event = 'gate_block')::INT AS blocks, CASE WHEN bool_or(event = 'turn_end') THEN 'done' ELSE 'open' END AS state FROM ev JOIN c USING (turn_id) LEFT JOIN k USING (turn_id) GROUP BY 1""")
def x3(spark, d):
    return T.turns(events(spark, d))


@query("X4_partial_answer", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN left(text, length(text) // 2) ELSE text END AS answer FROM conversations")
def x4(spark, d):
    """A JSON answer: some are closed, others break off in the text or in an escape."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    said = F.when(F.col("turn") % 3 == 0, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text"))
    quoted = F.to_json(F.struct(said.alias("answer")))
    cut_off = F.concat(F.expr("left(quoted, length(quoted) - 2)"), F.lit("\\u00"))
    rows = rows.withColumn("quoted", quoted).withColumn("raw", F.when(F.col("turn") % 3 == 0, cut_off).otherwise(F.col("quoted")))
    return rows.select("conv_id", "turn", T.partial_answer(F.col("raw")).alias("answer"))


@query("X5_tool_call_assembly", """WITH p AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN '{' ELSE '' END || l_partkey AS part, CASE WHEN l_linenumber % 2 = 1 THEN 'n' || l_linenumber END AS name, CASE WHEN l_linenumber < 3 THEN 'c' || l_partkey END AS id FROM lineitem)
SELECT l_orderkey AS turn_id, l_returnflag AS part_of, coalesce(arg_max(id, (l_linenumber, l_partkey)) FILTER (WHERE id IS NOT NULL), '') AS id, coalesce(arg_max(name, (l_linenumber, l_partkey)) FILTER (WHERE name IS NOT NULL), '') AS name,
CASE WHEN l_orderkey % 5 = 0 OR regexp_matches(string_agg(part, '' ORDER BY l_linenumber, l_partkey), '^0.') THEN '{}' ELSE string_agg(part, '' ORDER BY l_linenumber, l_partkey) END AS arguments FROM p GROUP BY 1, 2""")
def x5(spark, d):
    """Order lines are parts of calls; ids and names come with some of them, every fifth order's arguments
    are broken, and numbers that begin with 0 are no JSON."""
    line, number = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("turn_id"), F.col("l_returnflag").alias("index"), (line.cast("long") * 100000000 + F.col("l_partkey")).alias("seq"),
        F.when(line < 3, F.concat(F.lit("c"), number)).alias("id"), F.when(line % 2 == 1, F.concat(F.lit("n"), line.cast("string"))).alias("name"),
        F.concat(F.when(F.col("l_orderkey") % 5 == 0, "{").otherwise(""), number).alias("part"),
    )
    return T.assembled_calls(rows).withColumnRenamed("index", "part_of")


@query("X6_tool_loop", """WITH RECURSIVE k AS (SELECT user_id AS turn_id, user_id % 2 = 0 AS deep, user_id % 3 <> 0 AS material, event_type IN ('purchase', 'error') AS answered, event_type IN ('view', 'click') AS searched, event_type = 'view' AS evidence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT turn_id, 0::BIGINT AS rn, false AS s, false AS e, 0 AS blocks, '' AS ended FROM k WHERE rn = 1
  UNION ALL SELECT k.turn_id, k.rn, f.s OR (k.searched AND NOT k.answered), f.e OR (k.evidence AND NOT k.answered), f.blocks + (k.answered AND k.material AND CASE WHEN k.deep THEN NOT f.e ELSE f.blocks = 0 AND NOT f.s END)::INT,
  CASE WHEN NOT k.answered THEN '' WHEN k.deep AND NOT f.e AND k.material THEN CASE WHEN f.blocks = 1 THEN 'no_evidence_after_gate' ELSE '' END WHEN NOT k.deep AND f.blocks = 0 AND k.material AND NOT f.s THEN '' ELSE 'answered' END
  FROM f JOIN k ON k.turn_id = f.turn_id AND k.rn = f.rn + 1 WHERE f.ended = '' AND k.rn <= 6),
l AS (SELECT turn_id, max(rn) AS rn FROM f GROUP BY 1)
SELECT turn_id, rn::INT AS rounds, blocks, e AS evidence, CASE WHEN ended <> '' THEN ended WHEN rn = 6 THEN 'max_steps_without_answer' ELSE 'open' END AS reason FROM f JOIN l USING (turn_id, rn)""")
def x6(spark, d):
    """Purchases and errors answer, views and clicks search, views bring evidence; even users are deep."""
    rows, kind = spark.read.parquet(f"{d}/events.parquet"), F.col("event_type")
    mode = F.when(F.col("user_id") % 2 == 0, "deep").otherwise("chat")
    return T.replay(rows.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("round"), mode.alias("mode"), (F.col("user_id") % 3 != 0).alias("material"), kind.isin("purchase", "error").alias("answered"), kind.isin("view", "click").alias("searched"), (kind == "view").alias("evidence")))


@query("X8_summary_trigger", "SELECT conv_id AS session_id, CASE WHEN b > conv_id % 3 THEN b END AS boundary, coalesce(b > conv_id % 3, false) AND conv_id % 5 < 3 AS due FROM (SELECT conv_id, max(turn) FILTER (WHERE back > 3) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) GROUP BY 1)")
def x8(spark, d):
    """Sessions with something covered already, and some whose summaries have failed too often."""
    messages = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"))
    sessions = messages.select("session_id").distinct().select("session_id", (F.col("session_id") % 3).alias("covered"), (F.col("session_id") % 5).alias("failures"))
    return due_sessions(messages, sessions, keep=3)


@query("X10_versioned_cache", "SELECT label, count(*) AS n, 2::BIGINT AS hits, 2::BIGINT AS misses FROM embeddings GROUP BY 1")
def x10(spark, d):
    """The same version is read from the cache, another version is built."""
    cache, path = VersionedCache(ttl_s=30), f"{d}/embeddings.parquet"
    build = lambda: spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    for version in (1, 1, 2):
        cache.get("labels", version, build)
    out = cache.get("labels", 2, build)
    return out.select("label", "n", F.lit(cache.hits).cast("long").alias("hits"), F.lit(cache.misses).cast("long").alias("misses"))


@query("X13_scripted_adapter", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), h AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM r WHERE rn <= 3 GROUP BY 1) SELECT event_id, CASE event_id % 10 WHEN 9 THEN 'timeout' WHEN 4 THEN 'unavailable' END AS error, CASE WHEN event_id % 10 IN (4, 9) THEN '' ELSE coalesce(ids, '') END AS ids FROM events LEFT JOIN h ON h.source = 'src' || (user_id % 25)")
def x13(spark, d):
    asked = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("collection"), (F.col("event_id") % 10).alias("call_no"))
    held = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("collection"), F.col("doc_id").alias("document_id"))
    out = scripted_search(asked, held, {9: "timeout", 4: "unavailable"}, 3)
    return out.select(F.col("request_id").alias("event_id"), "error", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("J20_result_to_call", f"WITH {EVT} SELECT r.turn_id, r.seq, max(c.seq) AS call_seq FROM ev r LEFT JOIN ev c ON c.turn_id = r.turn_id AND c.event = 'tool_call' AND c.round = r.round AND c.call_index = r.call_index AND c.seq < r.seq WHERE r.event = 'tool_result' GROUP BY 1, 2")
def j20(spark, d):
    w = Window.partitionBy("turn_id", "round", "call_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, d).withColumn("call_seq", F.max(F.when(F.col("event") == "tool_call", F.col("seq"))).over(w))
    return rows.where("event = 'tool_result'").select("turn_id", "seq", "call_seq")


@query("stream_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return T.windows(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
