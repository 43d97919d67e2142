"""Chunking queries over the lines of the documents and the lines of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import as_int, query
from ..operators import chunks as C
from ..operators import elements as E
from .elements import EL, elements


def _el(body: str) -> str:
    return f"WITH {EL}{body}"


@query("C1_token_estimate", _el(" SELECT document_id, ordinal, greatest(1, length(text) // 4)::INT AS tokens FROM el"))
def c1(spark, d):
    return elements(spark, d).select("document_id", "ordinal", E.tokens(F.col("text")).alias("tokens"))


_ROLE = _el(""", ro AS (SELECT *, CASE WHEN type = 'footnote' THEN 'footnote' WHEN type = 'caption' AND ordinal % 2 = 0 THEN 'noise' WHEN ordinal % 7 = 3 THEN 'reference' ELSE 'body' END AS role, CASE WHEN ordinal % 5 = 4 THEN 'skip' WHEN ordinal % 11 = 10 THEN 'drop' ELSE 'embed' END AS index_policy FROM el)""")


def _with_roles(spark, d):
    role = F.when(F.col("type") == "footnote", "footnote").when((F.col("type") == "caption") & (F.col("ordinal") % 2 == 0), "noise").when(F.col("ordinal") % 7 == 3, "reference").otherwise("body")
    rule = F.when(F.col("ordinal") % 5 == 4, "skip").when(F.col("ordinal") % 11 == 10, "drop").otherwise("embed")
    return elements(spark, d).withColumn("role", role).withColumn("index_policy", rule)


@query("C2_policy_filter", _ROLE + " SELECT document_id, role, count(*) AS dropped FROM ro WHERE index_policy <> 'embed' OR role <> 'body' GROUP BY 1, 2")
def c2(spark, d):
    return C.dropped_by_role(_with_roles(spark, d), ["document_id"])


@query("C3_byline_demotion", _el(r""", b AS (SELECT *, EXISTS (SELECT 1 FROM el h WHERE h.document_id = el.document_id AND h.ordinal < el.ordinal AND h.type = 'heading' AND (starts_with(lower(trim(h.text)), 'abstract') OR regexp_matches(trim(h.text), '^\d+(\.\d+)*\s+'))) AS seen FROM el)
SELECT document_id, ordinal, trim(text) = '' OR (NOT seen AND (regexp_matches(text, '(?i)(https?://|www\.)') OR regexp_matches(text, '\b[\w.-]+@[\w.-]+\.\w+\b') OR (length(trim(text)) <= 180 AND (regexp_matches(text, '(?i)\b(university|laboratory|department|institute|gmbh|ltd\.?|inc\.?)\b') OR regexp_matches(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b'))))) AS byline FROM b WHERE type = 'paragraph'""".replace("FROM el h", "FROM marked h").replace("FROM el)", "FROM marked el)").replace(", b AS", ", marked AS (SELECT * REPLACE (CASE WHEN type = 'heading' AND ordinal % 3 = 2 THEN '3.1 ' || text WHEN type = 'heading' AND ordinal % 3 = 1 THEN ' Abstract ' || text ELSE text END AS text) FROM el), b AS")))
def c3(spark, d):
    """A third of the headings gets a number, another one is an abstract."""
    title = F.when(F.col("ordinal") % 3 == 2, F.concat(F.lit("3.1 "), "text")).when(F.col("ordinal") % 3 == 1, F.concat(F.lit(" Abstract "), "text")).otherwise(F.col("text"))
    rows = elements(spark, d).withColumn("text", F.when(F.col("type") == "heading", title).otherwise(F.col("text")))
    rows = rows.withColumn("seen", C.body_begun()).where("type = 'paragraph'")
    return rows.select("document_id", "ordinal", C.is_byline(F.lit("body"), F.col("text"), ~F.col("seen")).alias("byline"))


@query("W2_exclusive_running_flag", _el(" SELECT document_id, ordinal, EXISTS (SELECT 1 FROM el b WHERE b.document_id = el.document_id AND b.ordinal < el.ordinal AND b.type = 'heading') AS seen FROM el"))
def w2(spark, d):
    return elements(spark, d).select("document_id", "ordinal", F.coalesce(F.bool_or(F.col("type") == "heading").over(E.before()), F.lit(False)).alias("seen"))


@query("C4_prose_runs", _el(", r AS (SELECT *, sum((type IN ('heading', 'table', 'figure', 'formula'))::INT) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM el) SELECT document_id, run, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM r WHERE type IN ('paragraph', 'list_item') GROUP BY 1, 2"))
def c4(spark, d):
    prose = C.runs(elements(spark, d)).where("type in ('paragraph', 'list_item')")
    return prose.groupBy("document_id", "run").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"))


@query("W8_sessionization", _el(", c AS (SELECT *, (type <> coalesce(lag(type) OVER (PARTITION BY document_id ORDER BY ordinal), ''))::INT AS change FROM el) SELECT document_id, ordinal, sum(change) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM c"))
def w8(spark, d):
    change = (F.col("type") != F.coalesce(F.lag("type").over(E.doc_order()), F.lit(""))).cast("int")
    rows = elements(spark, d).withColumn("change", change)
    return rows.select("document_id", "ordinal", F.sum("change").over(E.upto()).alias("session"))


#: A path for the queries: the heading or caption that stands last before.
_PATHED = EL + r""", pa AS (SELECT *, coalesce(last_value(CASE WHEN type IN ('heading', 'caption') THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS path FROM el),
pl AS (SELECT * FROM (SELECT *, sum((type IN ('heading', 'table', 'figure', 'formula'))::INT) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS part FROM pa) WHERE type IN ('paragraph', 'list_item')),
pr AS (SELECT document_id, ordinal, trim(text) AS body, path, CASE WHEN path = '' THEN 0 ELSE length(path) + 1 END AS lead, part IS NOT DISTINCT FROM lag(part) OVER w AND path IS NOT DISTINCT FROM lag(path) OVER w AS same, row_number() OVER w AS rn FROM pl WHERE trim(text) <> '' WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
mg AS (SELECT document_id, rn, ordinal AS first, length(body) AS chars FROM pr WHERE rn = 1
  UNION ALL SELECT p.document_id, p.rn, CASE WHEN p.same AND greatest(1, (p.lead + m.chars + 1 + length(p.body)) // 4) <= 320 THEN m.first ELSE p.ordinal END, CASE WHEN p.same AND greatest(1, (p.lead + m.chars + 1 + length(p.body)) // 4) <= 320 THEN m.chars + 1 ELSE 0 END + length(p.body)
  FROM mg m JOIN pr p ON p.document_id = m.document_id AND p.rn = m.rn + 1)"""


def pathed(spark, d):
    path = F.last(F.when(F.col("type").isin("heading", "caption"), F.col("text")), ignorenulls=True).over(E.before())
    return elements(spark, d).withColumn("path", F.coalesce(path, F.lit("")))


@query("C5_greedy_merge", f"WITH RECURSIVE {_PATHED} SELECT m.document_id, m.first, max(p.ordinal) AS last, max(m.chars)::BIGINT AS chars FROM mg m JOIN pr p USING (document_id, rn) GROUP BY 1, 2")
def c5(spark, d):
    """The merged texts, before what is too long is split."""
    return C.packed_prose(pathed(spark, d)).select("document_id", "first", "last", "chars").distinct()


@query("C6_split_long_prose")
def c6(spark, d):
    """Sentences repacked and overlapped; the tests hold it against a plain version."""
    rows = C.prose_chunks(pathed(spark, d).where(F.length("text") > 1500))
    return rows.select("document_id", "first", "piece", F.sha2("text", 256).alias("sha"))


_OVER = _el(r""", p AS (SELECT document_id, ordinal, text, lag(text) OVER (PARTITION BY document_id ORDER BY ordinal) AS prev FROM el),
t AS (SELECT *, CASE WHEN length(prev) <= 256 THEN prev WHEN len(list_filter(regexp_split_to_array(right(prev, 256), '[\s]+'), lambda x: x <> '')) > 1 THEN array_to_string(list_filter(regexp_split_to_array(right(prev, 256), '[\s]+'), lambda x: x <> '')[2:], ' ') ELSE right(prev, 256) END AS tl FROM p)
SELECT document_id, ordinal, CASE WHEN prev IS NULL OR length(trim(tl || ' ' || text)) > 2051 THEN text ELSE trim(tl || ' ' || text) END AS text FROM t""")


@query("C7_overlap", _OVER)
def c7(spark, d):
    """Every line as a piece after the line before it."""
    return elements(spark, d).select("document_id", "ordinal", C.overlap(F.lag("text").over(E.doc_order()), F.col("text"), F.lit(0)).alias("text"))


@query("W6_lag_previous_piece", _el(" SELECT document_id, ordinal, length(lag(text) OVER (PARTITION BY document_id ORDER BY ordinal)) AS before FROM el"))
def w6(spark, d):
    return elements(spark, d).select("document_id", "ordinal", F.length(F.lag("text").over(E.doc_order())).cast("long").alias("before"))


@query("C8_formula_chunk", f"WITH {_PATHED.split(', pl AS')[0]} SELECT document_id, ordinal, CASE WHEN ordinal % 2 = 0 AND trim(text) <> '' THEN trim(text) WHEN path = '' THEN trim('[formula] ' || text) ELSE path || chr(10) || trim('[formula] ' || text) END AS retrieval_text, ordinal % 3 = 0 AS degraded FROM pa WHERE type = 'formula'")
def c8(spark, d):
    """Every other formula has a search text; every third was not parsed."""
    even, none = F.col("ordinal") % 2 == 0, F.lit(None).cast("string")
    rows = pathed(spark, d).withColumn("latex", F.col("text")).withColumn("text", F.when(even, F.col("text")))
    rows = rows.withColumns({"search_text": F.col("text"), "context": none, "parse_status": F.when(F.col("ordinal") % 3 == 0, "unparsed").otherwise("parsed")})
    return C.formula_chunks(rows)


@query("C9_figure_chunk", f"WITH {_PATHED.split(', pl AS')[0]} SELECT document_id, ordinal, CASE WHEN path = '' THEN '' ELSE path || chr(10) END || trim('[figure] ' || trim(text)) AS retrieval_text, 'figure:e' || ordinal AS parent_id FROM pa WHERE type = 'figure'")
def c9(spark, d):
    rows = pathed(spark, d).withColumns({"caption": F.lit(None).cast("string"), "element_id": F.concat(F.lit("e"), F.col("ordinal").cast("string"))})
    return C.figure_chunks(rows)


_ROWS = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, 'part: ' || l_partkey || ' | flag: ' || l_returnflag AS line FROM lineitem)"


def _rows(spark, d):
    line = F.concat(F.lit("part: "), F.col("l_partkey").cast("string"), F.lit(" | flag: "), "l_returnflag")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


@query("C10_table_summary", """WITH r AS (SELECT *, '[table-fact] t | ' || l_partkey || ' | flag | ' || l_returnflag AS fact, row_number() OVER w AS rn, sum(greatest(1, length('[table-fact] t | ' || l_partkey || ' | flag | ' || l_returnflag) // 4) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS UNBOUNDED PRECEDING) AS used FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag))
SELECT l_orderkey AS table_id, 'filename: orders.csv' || chr(10) || '[table-summary] order ' || l_orderkey || chr(10) || 'columns: part | flag' || chr(10) || 'row_labels: ' || string_agg(l_partkey::VARCHAR, '; ' ORDER BY rn) FILTER (WHERE rn <= 15) || chr(10)
 || 'highlights: ' || string_agg(l_partkey || ' | flag | ' || l_returnflag, ' ; ' ORDER BY rn) FILTER (WHERE rn = 1 OR used <= 256) || chr(10) || 'shape: ' || count(*) || ' rows × 2 cols' AS retrieval_text FROM r GROUP BY 1""")
def c10(spark, d):
    """Order lines are the rows of one table per order; up to 15 row labels: the cap is the feature."""
    text = F.col("l_partkey").cast("string")
    fact = F.concat_ws(" | ", F.lit("[table-fact] t"), text, F.lit("flag"), "l_returnflag")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", text.alias("label"), fact.alias("fact")).alias("r"))
    tables = rows.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    pick = lambda c: F.transform("rows", lambda r: r[c])
    tables = tables.select("table_id", F.concat(F.lit("order "), F.col("table_id").cast("string")).alias("caption"), F.array(F.lit("part"), F.lit("flag")).alias("headers"), pick("label").alias("labels"), F.size("rows").alias("n_rows"), pick("fact").alias("facts"), C.file_prefix(F.lit("orders.csv")).alias("prefix"))
    return C.table_summaries(tables)


@query("C11_table_packs", f"""WITH RECURSIVE {_ROWS}, n AS (SELECT l_orderkey, line, length(line) + 1 AS cost, 2051 - 40 - 20 * (l_orderkey % 5) AS head, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line) AS rn FROM r),
w AS (SELECT l_orderkey, rn, head + cost AS used, 0 AS pack FROM n WHERE rn = 1 UNION ALL SELECT n.l_orderkey, n.rn, CASE WHEN (w.used + n.cost) // 4 <= 512 THEN w.used + n.cost ELSE n.head + n.cost END, CASE WHEN (w.used + n.cost) // 4 <= 512 THEN w.pack ELSE w.pack + 1 END FROM w JOIN n ON n.l_orderkey = w.l_orderkey AND n.rn = w.rn + 1)
SELECT l_orderkey, pack::INT AS pack, count(*) AS n FROM w GROUP BY 1, 2""")
def c11(spark, d):
    """One table an order; what stands before its lines takes all but 40 to 120 of the characters."""
    head = F.lit(2051 - 40) - 20 * (F.col("l_orderkey") % 5)
    packs = C.table_packs(_rows(spark, d), ["l_orderkey"], "l_linenumber", "line", head)
    return packs.groupBy("l_orderkey", "pack").agg(F.count(F.lit(1)).alias("n"))


_PACKED = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
t AS (SELECT DISTINCT l_orderkey AS k, 'order ' || repeat('x', (l_orderkey % 3 * 100)::INT) AS cap, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'filename: ' || l_orderkey || '.csv' END AS prefix FROM lineitem),
h AS (SELECT k, prefix, '[table] ' || CASE WHEN length(cap) > 200 THEN substr(cap, 1, 199) || '…' ELSE cap END || chr(10) || CASE WHEN k % 7 = 0 THEN '' ELSE 'headers: part | ship' END AS head FROM t),
l AS (SELECT l_orderkey AS k, rn, CASE WHEN k % 7 <> 0 THEN 'part: ' || l_partkey || ' | ship: ' || l_linestatus || ' | ' || repeat('n', (l_partkey % 200)::INT) WHEN k % 2 = 0 THEN l_partkey || ' | ship | ' || l_linestatus END AS line FROM o),
m AS (SELECT k, rn, coalesce(line, 'whole order ' || k) AS line FROM l WHERE line IS NOT NULL OR rn = 1),
n AS (SELECT m.*, prefix, head, length(head) + CASE WHEN prefix = '' THEN 0 ELSE length(prefix) + 1 END AS room FROM m JOIN h USING (k)),
w AS (SELECT k, rn, room + length(line) + 1 AS used, 0 AS pack FROM n WHERE rn = 1 UNION ALL
 SELECT n.k, n.rn, CASE WHEN (w.used + length(rtrim(n.line)) + 1) // 4 <= 512 THEN w.used ELSE n.room END + length(n.line) + 1, CASE WHEN (w.used + length(rtrim(n.line)) + 1) // 4 <= 512 THEN w.pack ELSE w.pack + 1 END FROM w JOIN n ON n.k = w.k AND n.rn = w.rn + 1)
SELECT k AS table_id, pack::INT AS pack, CASE WHEN any_value(prefix) = '' THEN '' ELSE any_value(prefix) || chr(10) END || trim(any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY rn), ' ' || chr(10)) AS retrieval_text, false AS over
FROM w JOIN n USING (k, rn) GROUP BY 1, 2"""


@query("C11_tables_packed", _PACKED)
def c11_tables(spark, d):
    """Whole tables, one an order: rows under headers; every seventh table has no headers, so its facts
    or, for odd ones, its text take their place."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("rn", F.row_number().over(by))
    filler = F.repeat(F.lit("n"), (part % 200).cast("int"))
    rows = items.select(k.alias("table_id"), F.col("rn").alias("row_no"), F.array(part.cast("string"), F.col("l_linestatus"), filler).alias("cells"))
    fact = F.concat(F.lit("[table-fact] t | "), part.cast("string"), F.lit(" | ship | "), F.col("l_linestatus"))
    facts = F.transform(F.array_sort(F.collect_list(F.struct("rn", fact.alias("fact")))), lambda s: s["fact"])
    bare, none = k % 7 == 0, F.array().cast("array<string>")
    tables = items.groupBy("l_orderkey").agg(facts.alias("facts")).select(
        k.alias("table_id"), F.concat(F.lit("order "), F.repeat(F.lit("x"), (k % 3 * 100).cast("int"))).alias("caption"),
        F.when(bare, none).otherwise(F.array(F.lit("part"), F.lit("ship"))).alias("headers"), F.when(bare & (k % 2 == 0), F.col("facts")).otherwise(none).alias("facts"),
        F.concat(F.lit("whole order "), k.cast("string")).alias("text"), C.file_prefix(F.concat(k.cast("string"), F.when(k % 4 == 0, ".pdf").otherwise(".csv"))).alias("prefix"),
    )
    return C.tables_packed(tables, rows)


@query("C12_file_identity_prefix", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'filename: ' || doc_id || '.csv' END AS prefix FROM documents")
def c12(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".csv"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", C.file_prefix(name).alias("prefix"))


@query("C13_fact_compaction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'orders | ' || l_returnflag ELSE l_returnflag || ' | qty | ' || l_quantity::INT END AS fact FROM lineitem")
def c13(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    long = F.concat_ws(" | ", F.lit("[table-fact] orders"), "l_returnflag", F.lit("qty"), F.col("l_quantity").cast("int").cast("string"))
    fact = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(" | ", F.lit("[table-fact] orders"), "l_returnflag")).otherwise(long)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", C.compact_fact(fact).alias("fact"))


@query("C14_truncate_ellipsis", _el(" SELECT document_id, ordinal, CASE WHEN length(text) > 80 THEN rtrim(left(text, 79)) || '…' ELSE text END AS text FROM el"))
def c14(spark, d):
    return elements(spark, d).select("document_id", "ordinal", C.truncate(F.col("text"), 20).alias("text"))


@query("C15_page_span", _el(" SELECT document_id, coalesce(min(page), 1) AS page, coalesce(max(page), 1) AS page_end, len(list_distinct(coalesce(list(page) FILTER (WHERE page IS NOT NULL), [1]))) AS n_pages FROM el GROUP BY 1"))
def c15(spark, d):
    rows = elements(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_set("page")).alias("p"))
    pages = F.when(F.size("p") > 0, F.col("p")).otherwise(F.array(F.lit(1)))
    return rows.select("document_id", F.array_min(pages).alias("page"), F.array_max(pages).alias("page_end"), F.size(pages).cast("long").alias("n_pages"))


@query("C16_stable_chunk_id", _el(r" SELECT document_id, ordinal, 'chk_' || left(sha1(document_id || '|r1|prose|e' || ordinal || '|-1|' || lower(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g'))), 20) AS chunk_id FROM el"))
def c16(spark, d):
    ids = F.array(F.concat(F.lit("e"), F.col("ordinal").cast("string")))
    return elements(spark, d).select("document_id", "ordinal", C.chunk_id(F.col("document_id"), F.lit("r1"), F.lit("prose"), ids, F.lit(-1), F.col("text")).alias("chunk_id"))


@query("C17_reading_order_merge", as_int("place", _el(" SELECT document_id, ordinal, row_number() OVER (PARTITION BY document_id ORDER BY ordinal + (type IN ('paragraph', 'list_item'))::INT, (type NOT IN ('paragraph', 'list_item'))::INT, ordinal) AS place FROM el")))
def c17(spark, d):
    """Prose is keyed by the 1-based digits of its element id, structure by its 0-based ordinal."""
    rows = elements(spark, d)
    prose = F.col("type").isin("paragraph", "list_item")
    a = rows.where(prose).select("document_id", "ordinal", (F.col("ordinal") + 1).alias("key"), F.lit(0).alias("kind"))
    b = rows.where(~prose).select("document_id", "ordinal", F.col("ordinal").alias("key"), F.lit(1).alias("kind"))
    w = Window.partitionBy("document_id").orderBy("key", "kind", "ordinal")
    return a.unionByName(b).select("document_id", "ordinal", F.row_number().over(w).alias("place"))


_NEAR = _el(""", a AS (SELECT * FROM el WHERE type IN ('table', 'figure')), p AS (SELECT * FROM el WHERE type IN ('paragraph', 'list_item')),
b AS (SELECT a.document_id, a.ordinal, p.ordinal AS o, row_number() OVER (PARTITION BY a.document_id, a.ordinal, p.ordinal < a.ordinal ORDER BY abs(p.ordinal - a.ordinal)) AS r FROM a LEFT JOIN p ON p.document_id = a.document_id)
SELECT document_id, ordinal, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (WHERE r <= 2 AND o < ordinal), '') AS prev, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (WHERE r <= 2 AND o > ordinal), '') AS next FROM b GROUP BY 1, 2""")


def _neighbors(spark, d):
    rows = elements(spark, d).where(F.col("type").isin("table", "figure", "paragraph", "list_item"))
    rows = rows.select("document_id", F.col("ordinal").alias("chunk_id"), F.col("ordinal").alias("anchor"), F.col("type").isin("paragraph", "list_item").alias("prose"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return C.neighbors(rows).select("document_id", F.col("chunk_id").alias("ordinal"), text("prev"), text("next"))


@query("C18_neighbor_binding", _NEAR)
def c18(spark, d):
    return _neighbors(spark, d)


@query("J10_nearest_k_join", _NEAR.replace("SELECT document_id, ordinal, coalesce(string_agg", "SELECT document_id, ordinal, count(*) FILTER (WHERE r <= 2) AS n, coalesce(string_agg").rsplit(", coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (WHERE r <= 2 AND o < ordinal)", 1)[0] + " FROM b WHERE o IS NOT NULL GROUP BY 1, 2")
def j10(spark, d):
    rows = _neighbors(spark, d)
    size = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    return rows.select("document_id", "ordinal", (size("prev") + size("next")).cast("long").alias("n")).where("n > 0")


@query("C19_final_clamp", _el(" SELECT document_id, ordinal, CASE WHEN greatest(1, length(text) // 4) > 520 THEN rtrim(left(text, 2047)) || '…' ELSE text END AS text, greatest(1, length(text) // 4) > 520 AS truncated FROM el"))
def c19(spark, d):
    return elements(spark, d).select("document_id", "ordinal", C.clamp(F.col("text")).alias("text"), (E.tokens(F.col("text")) > C.CLAMP).alias("truncated"))


@query("C20_chunk_report", _el(" SELECT document_id, count(*) AS chunks, max(greatest(1, length(text) // 4))::INT AS max_tokens, count(*) FILTER (WHERE type = 'figure') AS figures, count(*) FILTER (WHERE length(text) // 4 > 520) AS truncated FROM el WHERE type <> 'footnote' GROUP BY 1"))
def c20(spark, d):
    t = E.tokens(F.col("text"))
    rows = elements(spark, d).where("type <> 'footnote'").groupBy("document_id")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.max(t).alias("max_tokens"), F.count_if(F.col("type") == "figure").alias("figures"), F.count_if(t > C.CLAMP).alias("truncated"))
