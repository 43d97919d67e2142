"""Upload, artifact, snapshot and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import as_int, query
from ..functions.storage import work_folder
from ..operators import snapshot as N
from ..operators.elements import tokens
from ..operators.retrieve import present, rerank, reranked, run_variants, shared_words
from ..operators.vectors import hashed_bow, token_batches
from ..sources import artifacts as A
from ..sources import uploads as U
from .publication import published
from .retrieval import _with, channels


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("S1_upload_gate", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_mime' WHEN 2 THEN 'bad_extension' ELSE 'ok' END AS verdict FROM documents")
def s1(spark, d):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.concat(F.lit("dir\\x/"), n, F.when(k == 0, ".CSV").when(k == 1, ".pdf").when(k == 2, ".exe").otherwise(".html"))
    mime = F.when(k == 0, "text/plain").when(k == 1, "text/html").otherwise("application/octet-stream")
    return _docs(spark, d).select("doc_id", U.gate(name, mime).alias("verdict"))


@query("S2_size_and_magic", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad_magic' WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'ok' END AS verdict FROM documents")
def s2(spark, d):
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ext = F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("md")
    return _docs(spark, d).select("doc_id", U.check(ext, text).alias("verdict"))


@query("S3_html_parse")
def s3(spark, d):
    """Elements of raw pages; an HTML parser has no SQL twin."""
    files = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("document_id"), F.lit("html").alias("kind"), F.col("html").alias("content"))
    return U.parsed(files)


def _stored_files(spark: SparkSession, d: str) -> DataFrame:
    """Every third text as UTF-16 with a BOM, every third in a single-byte code, the rest as UTF-8."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k == 1, F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return _docs(spark, d).select(F.col("doc_id").alias("document_id"), raw.alias("content"))


_FILES = "f AS (SELECT doc_id AS document_id, coalesce(text, '') AS text, doc_id % 3 = 1 AND regexp_matches(coalesce(text, ''), '[\\x{80}-\\x{FF}]') AS odd FROM documents)"


@query("S4_encoding_sniff", f"WITH {_FILES} SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'utf-16-le' WHEN odd THEN NULL ELSE 'utf-8' END AS encoding FROM f")
def s4(spark, d):
    """Accented letters in a single-byte code are refused."""
    return U.transcoded(_stored_files(spark, d)).select("document_id", "encoding")


@query("S5_transcode", f"WITH {_FILES} SELECT document_id, CASE WHEN odd THEN NULL WHEN document_id % 3 = 1 THEN regexp_replace(text, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') ELSE text END AS text FROM f")
def s5(spark, d):
    return U.transcoded(_stored_files(spark, d)).select("document_id", "text")


@query("S7_ordered_scan", "SELECT DISTINCT doc_id::VARCHAR AS document_id, l.doc_id IS NOT NULL AS found, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT END AS n FROM documents LEFT JOIN labels l USING (doc_id)")
def s7(spark, d):
    """Ordered files of the labelled documents are written and scanned; those without one are told."""
    path = work_folder(spark, "ordered")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    labels.select(F.col("doc_id").cast("string").alias("document_id"), F.array_repeat(F.struct(F.lit("paragraph").alias("type")), F.col("quality").cast("int")).alias("sequence")).write.json(path)
    registry = _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    found, missing = A.ordered_documents(spark, path, registry, "document_id string, sequence array<struct<type string>>", lines=True)
    return found.select("document_id", F.lit(True).alias("found"), F.size("sequence").cast("long").alias("n")).unionByName(missing.select("document_id", F.lit(False).alias("found"), F.lit(None).cast("long").alias("n")))


@query("S8_chunk_jsonl_scan", "WITH l AS (SELECT doc_id % 50 AS file, 'c' || doc_id AS chunk_id, doc_id % 97 = 0 OR doc_id % 89 = 0 AS broken FROM documents) SELECT file, chunk_id FROM l WHERE file NOT IN (SELECT file FROM l WHERE broken)")
def s8(spark, d):
    k = F.col("doc_id")
    name = F.concat(F.lit('{"chunk_id": "c'), k.cast("string"), F.lit('"}'))
    lines = _docs(spark, d).select((k % 50).alias("file"), F.when(k % 97 == 0, "{broken").when(k % 89 == 0, '{"text": "x"}').otherwise(name).alias("value"))
    return A.readable_chunks(lines, "chunk_id string")


@query("S9_registry_scan", "SELECT doc_id::VARCHAR AS document_id, source AS status, n_chars::INT AS page_count FROM documents")
def s9(spark, d):
    """Records with a key that is not declared are written and read back."""
    path = work_folder(spark, "registry")
    _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("status"), F.col("n_chars").alias("page_count"), F.lit(1).alias("undeclared")).write.json(path)
    return A.read_registry(spark, path, lines=True).select("document_id", "status", "page_count")


@query("S10_snapshot_load", "SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings) AS chunk_count FROM embeddings GROUP BY 1")
def s10(spark, d):
    """Pointer, version, vectors and manifest of a published snapshot."""
    root = published(spark, d)
    manifest = A.read_manifest(spark, root).select("chunk_count")
    return A.read_snapshot(spark, root).groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(manifest), F.lit(True)).select("label", "n", "chunk_count")


@query("S11_point_lookup", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 20 = 0")
def s11(spark, d):
    ids = _docs(spark, d).where("doc_id % 20 = 0").select("doc_id").distinct()
    return _docs(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("S12_table_siblings", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY coalesce(nullif(o_orderkey % 9, 0), -1), o_orderkey) AS siblings FROM orders GROUP BY 1")
def s12(spark, d):
    pack = F.coalesce(F.nullif(F.col("o_orderkey") % 9, F.lit(0)), F.lit(-1))
    rows = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(pack.alias("p"), "o_orderkey"))).alias("s"))
    return rows.select("o_custkey", F.array_join(F.transform("s", lambda x: x["o_orderkey"].cast("string")), ",").alias("siblings"))


@query("Q17_table_reassembly", "SELECT l_orderkey, string_agg(f, ' ' ORDER BY f) AS body FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS f FROM lineitem) GROUP BY 1")
def q17(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.collect_list(F.concat("l_returnflag", "l_linestatus")))).alias("parts"))
    return rows.select("l_orderkey", F.array_join("parts", " ").alias("body"))


@query("Q19_evidence_window", "SELECT conv_id, turn, concat_ws(chr(10), 'prev: ' || lag(text) OVER w, 'primary: ' || text, 'next: ' || lead(text) OVER w) AS evidence FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def q19(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.concat_ws("\n", part("prev", F.lag("text").over(w)), part("primary", F.col("text")), part("next", F.lead("text").over(w))).alias("evidence"))


@query("Q18_presentation_window", """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS own, coalesce(lag(text) OVER w, '') AS b, coalesce(lead(text) OVER w, '') AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, CASE WHEN length(own) <= 180 THEN length(own) ELSE least(length(own), 290) END AS n FROM c),
x AS (SELECT *, '[primary]' || chr(10) || left(own, n) || CASE WHEN length(own) > n THEN '…[本体省略 ' || (length(own) - n) || ' 字符]' ELSE '' END AS t0 FROM k),
y AS (SELECT *, CASE WHEN b = '' THEN t0 WHEN 280 - length(t0) < 120 THEN t0 || chr(10) || chr(10) || '…[邻居省略 ' || length(b) || ' 字符]' ELSE t0 || chr(10) || chr(10) || '[context:prev #1]' || chr(10) || left(b, 280 - length(t0)) || CASE WHEN length(b) > 280 - length(t0) THEN '…[邻居省略 ' || (length(b) - 280 + length(t0)) || ' 字符]' ELSE '' END END AS t1 FROM x),
z AS (SELECT *, CASE WHEN a = '' THEN t1 WHEN 280 - length(t1) < 120 THEN t1 || chr(10) || chr(10) || '…[邻居省略 ' || length(a) || ' 字符]' ELSE t1 || chr(10) || chr(10) || '[context:next #1]' || chr(10) || left(a, 280 - length(t1)) || CASE WHEN length(a) > 280 - length(t1) THEN '…[邻居省略 ' || (length(a) - 280 + length(t1)) || ' 字符]' ELSE '' END END AS t2 FROM y)
SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN '[primary]' || chr(10) || left(own, 290) || CASE WHEN length(own) > 290 THEN '…[本体省略 ' || (length(own) - 290) || ' 字符]' ELSE '' END ELSE left(t2, 300) END AS "window" FROM z""")
def q18(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text", F.lag("text").over(w).alias("b"), F.lead("text").over(w).alias("a"))
    return rows.select("conv_id", "turn", present(F.col("text"), [F.col("b")], [F.col("a")], 300).alias("window"))


@query("Q20_result_projection", "SELECT event_id, coalesce(event_type, '') AS kind, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events")
def q20(spark, d):
    parsed = F.from_json("props", "k int")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce("event_type", F.lit("")).alias("kind"), F.coalesce(parsed["k"], F.lit(0)).alias("k"))


@query("Q9_lexical_rerank", as_int("place", "WITH p AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), x AS (SELECT a.item_id AS q, b.item_id AS c, round(len(list_intersect(a.w, b.w)) / len(a.w), 6) AS score FROM p a, p b WHERE a.item_id % 20 = 0) SELECT * FROM (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS place FROM x) WHERE place <= 5"))
def q9(spark, d):
    p = spark.read.parquet(f"{d}/benchmark.parquet")
    return rerank(p.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "text"), p.select(F.col("item_id").alias("c"), "text"))


@query("Q9_pool_rerank", as_int("place", r"""WITH n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT q.item_id AS request_id, j AS pos, (q.item_id * 3 + j * 7) % n AS chunk_id, q.text FROM benchmark q, n, (SELECT unnest(range(1, 16)) AS j) WHERE q.item_id % 4 = 0),
w AS (SELECT DISTINCT ON (request_id, chunk_id) p.request_id, p.chunk_id, p.pos, p.text, CASE WHEN chunk_id % 10 = 3 THEN ' ' ELSE c.text END AS content FROM p JOIN benchmark c ON c.item_id = p.chunk_id ORDER BY request_id, chunk_id, pos),
s AS (SELECT *, CASE WHEN trim(content) <> '' THEN round(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> ''))))::DOUBLE / len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))), 6) END AS score FROM w)
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, pos) AS place, true AS reranked FROM s"""))
def q9_pool(spark, d):
    """Every fourth passage asks; its pool is up to 15 others, some of them blank."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    n = items.count()
    chunks = items.select(F.col("item_id").alias("chunk_id"), F.when(F.col("item_id") % 10 == 3, " ").otherwise(F.col("text")).alias("content"))
    requests = items.where("item_id % 4 = 0").select(F.col("item_id").alias("request_id"), "text")
    pool = requests.select("request_id", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("pos")).withColumn("chunk_id", (F.col("request_id") * 3 + F.col("pos") * 7) % n)
    pool = pool.groupBy("request_id", "chunk_id").agg(F.min("pos").alias("pos"))
    return reranked(pool, requests, chunks, shared_words).select("request_id", "chunk_id", F.col("order").alias("place"), "reranked")


@query("S13_full_dump", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def s13(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("S14_vector_lookup", "SELECT d.doc_id, e.vec_id IS NOT NULL AS has_vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def s14(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v"))
    return _docs(spark, d).select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit(False)).alias("has_vector"))


@query("S23_figure_listing", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS media_type FROM documents WHERE doc_id % 3 < 2")
def s23(spark, d):
    name = F.concat(F.lit("../fig/"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".svg")), (F.col("doc_id") % 3 + 1).cast("int")))
    media = F.lit(None).cast("string")
    for e, m in U.IMAGES.items():
        media = F.when(U.extension(U.basename(name)) == e, m).otherwise(media)
    return _docs(spark, d).select("doc_id", media.alias("media_type")).where("media_type is not null")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every document now, and an older version that lacks some, had other texts and other counts."""
    k = F.col("doc_id")
    now = _docs(spark, d).select(k.alias("document_id"), F.sha1(F.coalesce("text", F.lit(""))).alias("revision"), F.when(k % 13 != 0, F.col("n_chars")).alias("chunk_count"))
    old = now.where("document_id % 11 <> 0").select("document_id", F.when(F.col("document_id") % 7 == 0, F.lit("old")).otherwise(F.col("revision")).alias("revision"), F.when(F.col("document_id") % 5 == 0, F.lit(-1)).otherwise(F.col("chunk_count")).alias("chunk_count"))
    return now, old


_REASON = "SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'new_document' WHEN doc_id % 7 = 0 THEN 'revision_changed' WHEN doc_id % 13 = 0 THEN 'chunks_unreadable' WHEN doc_id % 5 = 0 THEN 'count_mismatch' ELSE 'reused' END AS reason FROM documents"


@query("V5_reuse_plan", _REASON)
def v5(spark, d):
    return N.reuse_plan(*_versions(spark, d), F.lit(True))


@query("J13_previous_manifest_join", f"SELECT reason, count(*) AS n FROM ({_REASON}) GROUP BY 1")
def j13(spark, d):
    return N.reuse_plan(*_versions(spark, d), F.lit(True)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _reused(spark, d):
    chunks = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("chunk_id"), "text")
    old = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return N.reuse_vectors(chunks, old, hashed_bow)


@query("V6_vector_reuse", "SELECT item_id AS chunk_id, e.vec_id IS NOT NULL AS reused FROM benchmark LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) e ON vec_id = item_id")
def v6(spark, d):
    return _reused(spark, d).select("chunk_id", "reused")


@query("J14_vector_misses", "SELECT count(*) FILTER (WHERE e.vec_id IS NULL) AS missed, count(e.vec_id) AS found FROM benchmark LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) e ON vec_id = item_id")
def j14(spark, d):
    return _reused(spark, d).agg(F.count_if(~F.col("reused")).alias("missed"), F.count_if(F.col("reused")).alias("found"))


@query("V8_quality_roll_up", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 100) AS tiny FROM documents GROUP BY GROUPING SETS ((lang), ())")
def v8(spark, d):
    return _docs(spark, d).rollup("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("tiny"))


@query("V9_index_row_projection", "SELECT 'c' || doc_id AS chunk_id, coalesce(text, '') AS text, 'page' AS page_kind, coalesce(lang, '') AS section FROM documents")
def v9(spark, d):
    return _docs(spark, d).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit("page").alias("page_kind"), F.coalesce("lang", F.lit("")).alias("section"))


@query("V10_manifest_compatibility", "SELECT vec_id, CASE WHEN label = 3 THEN 'model_mismatch' WHEN vec_id % 5 = 0 THEN 'dimension_mismatch' ELSE 'ok' END AS state FROM embeddings")
def v10(spark, d):
    model = F.when(F.col("label") == 3, "other").otherwise("bow")
    size = F.size("embedding") - F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", N.compatible(model, size, "bow", 64).alias("state"))


@query("V2_query_embedding_prompt", "SELECT item_id, 'Instruct: find' || chr(10) || 'Query: ' || text AS prompt FROM benchmark")
def v2(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.concat(F.lit("Instruct: find\nQuery: "), "text").alias("prompt"))


@query("V3_token_budget_batches", """WITH RECURSIVE t AS (SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS n, row_number() OVER (ORDER BY greatest(1, length(coalesce(text, '')) // 4), doc_id) AS rn FROM documents),
w AS (SELECT doc_id, rn, n AS used, 1 AS rows, 0::BIGINT AS batch FROM t WHERE rn = 1 UNION ALL
 SELECT t.doc_id, t.rn, CASE WHEN w.rows < 8 AND w.used + t.n <= 4096 THEN w.used + t.n ELSE t.n END, CASE WHEN w.rows < 8 AND w.used + t.n <= 4096 THEN w.rows + 1 ELSE 1 END, CASE WHEN w.rows < 8 AND w.used + t.n <= 4096 THEN w.batch ELSE w.batch + 1 END FROM w JOIN t ON t.rn = w.rn + 1)
SELECT doc_id, batch FROM w""")
def v3(spark, d):
    """Length-sorted batches of at most 8 texts and, beyond the first, 4,096 tokens."""
    return token_batches(_docs(spark, d).select("doc_id", tokens(F.col("text")).alias("n")), "n", "doc_id", 4096, 8).select("doc_id", "batch")


@query("V23_embedding_guards", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN length(text) // 4 > 2048 THEN 'cut' ELSE 'ok' END AS guard FROM documents")
def v23(spark, d):
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", F.when(F.trim(text) == "", "blank").when(tokens(text) > 2048, "cut").otherwise("ok").alias("guard"))


@query("K3_metadata_flatten", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"doc_id\":' || doc_id || ',\"atomic\":1,\"pages\":\"[1,' || (doc_id % 9) || ']\"}' ELSE '{\"doc_id\":' || doc_id || ',\"pages\":\"[1,' || (doc_id % 9) || ']\"}' END AS metadata FROM documents")
def k3(spark, d):
    k = F.col("doc_id")
    rows = _docs(spark, d).select("doc_id", F.when(k % 2 == 0, F.lit(True)).alias("atomic"), F.array(F.lit(1).cast("long"), k % 9).alias("pages"), F.lit("x").alias("secret"))
    return N.flat_metadata(rows, ["doc_id", "atomic", "pages"]).select(F.get_json_object("metadata", "$.doc_id").cast("long").alias("doc_id"), "metadata")


@query("K5_manifest", "SELECT count(*) AS chunk_count, count(DISTINCT source) AS documents, array_to_string(list_sort(list_distinct(list(source))), ',') AS names FROM documents")
def k5(spark, d):
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("source").alias("documents"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("names"))


@query("K6_registry_upsert", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE d.lang END AS status, coalesce(l.quality::BIGINT, d.n_chars) AS page_count FROM documents d LEFT JOIN labels l USING (doc_id)")
def k6(spark, d):
    from ..operators.state import upsert

    old = _docs(spark, d).select("doc_id", F.col("lang").alias("status"), F.col("n_chars").alias("page_count"))
    new = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit("labelled").alias("status"), F.col("quality").cast("long").alias("page_count"))
    return upsert(old, new.join(old.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], ["status", "page_count"])


@query("K7_register_replace_delete", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'uploaded' ELSE lang END AS status FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id + 1000000, 'uploaded' FROM documents WHERE doc_id % 10 = 0")
def k7(spark, d):
    base = _docs(spark, d).select("doc_id", F.col("lang").alias("status"))
    deleted = base.where("doc_id % 6 = 0").select("doc_id")
    replaced = base.withColumn("status", F.when(F.col("doc_id") % 4 == 1, "uploaded").otherwise(F.col("status")))
    new = base.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("uploaded").alias("status"))
    return replaced.join(deleted, "doc_id", "left_anti").unionByName(new)


@query("K8_build_lock_state", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unreadable' WHEN event_id % 5 = 0 THEN 'no_start_time' WHEN event_id % 5000 > 3600 THEN 'expired' WHEN event_type = 'error' THEN 'holder_gone' ELSE 'held' END AS state FROM events")
def k8(spark, d):
    k = F.col("event_id")
    age = F.when(k % 5 != 0, k % 5000)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", N.lock_state(age, F.lit(True), F.col("event_type") != "error", k % 7 != 0).alias("state"))


_VARIANTS = _with("""x AS (SELECT 'baseline' AS variant, request_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(channel * 1000 + rank) AS seen FROM ch WHERE channel = 0 GROUP BY ALL UNION ALL SELECT 'pair', request_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)), min(channel * 1000 + rank) FROM ch GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, request_id ORDER BY round(s, 9) DESC, seen) AS place FROM x)
SELECT variant, count(DISTINCT request_id) AS questions, count(*) FILTER (WHERE chunk_id = request_id + 1) AS found, sum(place) FILTER (WHERE chunk_id = request_id + 1)::BIGINT AS places FROM r GROUP BY 1""", fused=False)


@query("V12_variant_runner", _VARIANTS)
def v12(spark, d):
    """Each request by its first text and by both, all variants in one job; the target is the next vector."""
    ranked = run_variants(channels(spark, d), {"baseline": (0,), "pair": (0, 1)})
    target = F.col("chunk_id") == F.col("request_id") + 1
    return ranked.groupBy("variant").agg(F.count_distinct("request_id").alias("questions"), F.count_if(target).alias("found"), F.sum(F.when(target, F.col("fused_rank")).cast("long")).alias("places"))
