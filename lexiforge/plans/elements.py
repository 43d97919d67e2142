"""Element, numbering, role and structure queries over the lines of the documents.

A line is an element; its type and level are rules over its text, so that SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import elements as E


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, ordinal, text): every line of every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text")).select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "text")


def elements(spark: SparkSession, d: str) -> DataFrame:
    """lines with type, label, level and a page that is unknown for every third of them."""
    n = F.length("text")
    kind = (
        F.when(F.col("text").contains(" | "), "table")
        .when(F.col("text").contains("%%%"), "footnote")
        .when(F.col("text").contains("$$$"), "formula")
        .when(F.col("text").contains("!!"), "figure")
        .when(n < 30, "heading")
        .when(n < 45, "caption")
        .when(F.col("text").endswith("e."), "list_item")
        .otherwise("paragraph")
    )
    rows = lines(spark, d).withColumn("type", kind)
    rows = rows.withColumn("label", F.when((F.col("type") == "heading") & (F.col("document_id") % 2 == 0) & (n < 12), "title").otherwise(F.col("type")))
    rows = rows.withColumn("level", F.when((F.col("type") == "heading") & (F.col("document_id") % 4 != 3), (n % 3 + 1).cast("int")))
    return rows.withColumn("page", F.when((F.col("document_id") + F.col("ordinal")) % 3 != 0, (F.floor(F.col("ordinal") / 5) + 1).cast("int")))


EL = """
ln AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal FROM documents),
k AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%%') THEN 'footnote' WHEN contains(text, '$$$') THEN 'formula' WHEN contains(text, '!!') THEN 'figure'
      WHEN length(text) < 30 THEN 'heading' WHEN length(text) < 45 THEN 'caption' WHEN text LIKE '%e.' THEN 'list_item' ELSE 'paragraph' END AS type FROM ln),
el AS (SELECT *, CASE WHEN type = 'heading' AND document_id % 2 = 0 AND length(text) < 12 THEN 'title' ELSE type END AS label,
       CASE WHEN type = 'heading' AND document_id % 4 <> 3 THEN (length(text) % 3 + 1)::INT END AS level,
       CASE WHEN (document_id + ordinal) % 3 <> 0 THEN (ordinal // 5 + 1)::INT END AS page FROM k)
"""


def _el(body: str) -> str:
    return f"WITH {EL}{body}"


@query("E1_label_map", _el(""", p AS (SELECT *, CASE WHEN ordinal = 0 THEN 'page_header' WHEN type = 'heading' THEN 'section_header' WHEN type = 'figure' THEN 'picture' WHEN type = 'paragraph' THEN 'text' WHEN type = 'footnote' THEN 'odd' ELSE type END AS parser FROM el),
m(parser, mapped) AS (VALUES ('section_header', 'heading'), ('text', 'paragraph'), ('picture', 'figure'), ('caption', 'caption'), ('formula', 'formula'), ('table', 'table'), ('list_item', 'list_item'))
SELECT coalesce(mapped, 'other') AS mapped, count(*) AS n FROM p LEFT JOIN m USING (parser) WHERE parser <> 'page_header' GROUP BY 1"""))
def e1(spark, d):
    parser = F.when(F.col("ordinal") == 0, "page_header").when(F.col("type") == "heading", "section_header").when(F.col("type") == "figure", "picture").when(F.col("type") == "paragraph", "text").when(F.col("type") == "footnote", "odd").otherwise(F.col("type"))
    rows = elements(spark, d).select(E.type_of_label(parser).alias("mapped")).where("mapped is not null")
    return rows.groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))


@query("E2_collapse_spaced_letters")
def e2(spark, d):
    """Lookarounds have no SQL twin; the tests hold it against a callback replacement."""
    rows = elements(spark, d).where("type = 'caption'")
    spaced = F.regexp_replace(F.col("text"), r"(?<=[A-Za-z])(?=[A-Za-z])", " ")
    return rows.select("document_id", "ordinal", E.collapse_spaced(spaced).alias("text"))


@query("E3_page_span", _el(", g AS (SELECT document_id, ordinal // 4 AS part, arg_min(page, ordinal) FILTER (WHERE page IS NOT NULL) AS page, arg_max(page, ordinal) FILTER (WHERE page IS NOT NULL) AS last FROM el GROUP BY 1, 2) SELECT document_id, part, page, CASE WHEN last <> page THEN last END AS page_end FROM g"))
def e3(spark, d):
    prov = F.transform(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("ordinal", "page")))), lambda s: s["page"])
    rows = elements(spark, d).groupBy("document_id", F.floor(F.col("ordinal") / 4).alias("part")).agg(prov.alias("prov"))
    first, last = F.try_element_at("prov", F.lit(1)), F.try_element_at("prov", F.lit(-1))
    return rows.select("document_id", "part", first.alias("page"), F.nullif(last, first).alias("page_end"))


@query("E4_empty_table_drop", _el(" SELECT document_id, count(*) FILTER (WHERE replace(replace(text, '|', ''), ' ', '') = '') AS dropped, count(*) FILTER (WHERE replace(replace(text, '|', ''), ' ', '') <> '') AS kept FROM el WHERE type = 'table' GROUP BY 1"))
def e4(spark, d):
    cells = F.filter(F.transform(F.split("text", r" \| "), E.strip), lambda c: c != "")
    blank = F.size(F.filter(cells, lambda c: c != "|")) == 0
    return elements(spark, d).where("type = 'table'").groupBy("document_id").agg(F.count_if(blank).alias("dropped"), F.count_if(~blank).alias("kept"))


@query("E5_empty_text_drop", _el(" SELECT document_id, count(*) AS n FROM el WHERE type IN ('figure', 'table') OR trim(text) <> '' GROUP BY 1"))
def e5(spark, d):
    rows = elements(spark, d).where(F.col("type").isin("figure", "table") | (E.strip(F.col("text")) != ""))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("E6_fragment_merge", f"""WITH RECURSIVE {EL}, c AS (SELECT document_id, ordinal, type, (ordinal // 5 + 1)::INT AS page, CASE ordinal % 5 WHEN 0 THEN lower(text) WHEN 4 THEN rtrim(regexp_replace(text, '[.!?]+$', '')) ELSE text END AS text FROM el),
s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM c WHERE NOT (type IN ('figure', 'caption', 'footnote') OR (type = 'heading' AND NOT regexp_matches(text, '^\\d+(\\.\\d+)*\\b')))),
f AS (SELECT document_id, rn, ordinal AS head, type, page, text, page AS page_end FROM s WHERE rn = 1
  UNION ALL SELECT s.document_id, s.rn, if(j.joins, f.head, s.ordinal), if(j.joins, f.type, s.type), if(j.joins, f.page, s.page), if(j.joins, if(f.text LIKE '%-', left(rtrim(f.text), length(rtrim(f.text)) - 1), rtrim(f.text) || ' ') || ltrim(s.text), s.text), s.page
  FROM f JOIN s ON s.document_id = f.document_id AND s.rn = f.rn + 1, LATERAL (SELECT s.type = 'paragraph' AND f.type = 'paragraph' AND s.page = f.page + 1 AND regexp_matches(ltrim(s.text), '^\\p{{Ll}}') AND rtrim(f.text) <> '' AND NOT regexp_matches(rtrim(f.text), '[.!?"”'':]$') AS joins) j),
o AS (SELECT document_id, head AS ordinal, arg_max(text, rn) AS text, min(page) AS page, max(page_end) AS page_end FROM f GROUP BY 1, 2 UNION ALL SELECT document_id, ordinal, text, page, page FROM c WHERE type IN ('figure', 'caption', 'footnote') OR (type = 'heading' AND NOT regexp_matches(text, '^\\d+(\\.\\d+)*\\b')))
SELECT document_id, count(*) AS n, count(*) FILTER (WHERE page_end > page) AS merged, sha256(string_agg(text, chr(10) ORDER BY ordinal)) AS texts FROM o GROUP BY 1""")
def e6(spark, d):
    rows = elements(spark, d).withColumn("text", F.when(F.col("ordinal") % 5 == 0, F.lower("text")).when(F.col("ordinal") % 5 == 4, F.rtrim(F.regexp_replace("text", r"[.!?]+$", ""))).otherwise(F.col("text")))
    rows = rows.withColumn("page", (F.floor(F.col("ordinal") / 5) + 1).cast("int"))
    out = E.merge_fragments(rows)
    return out.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_end") > F.col("page")).alias("merged"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n"), 256).alias("texts"))


@query("E7_demote_figure_titles", _el(", n AS (SELECT *, lead(type) OVER (PARTITION BY document_id ORDER BY ordinal) AS nxt FROM el) SELECT document_id, ordinal FROM n WHERE type = 'heading' AND nxt IN ('figure', 'caption') AND length(text) < 80 AND NOT regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\b')"))
def e7(spark, d):
    return E.demote_titles(elements(spark, d)).where("type = 'figure_title_candidate'").select("document_id", "ordinal")


@query("W5_lead_next_type", _el(" SELECT type, nxt, count(*) AS n FROM (SELECT type, coalesce(lead(type) OVER (PARTITION BY document_id ORDER BY ordinal), 'end') AS nxt FROM el) GROUP BY 1, 2"))
def w5(spark, d):
    rows = elements(spark, d).select("type", F.coalesce(F.lead("type").over(E.doc_order()), F.lit("end")).alias("nxt"))
    return rows.groupBy("type", "nxt").agg(F.count(F.lit(1)).alias("n"))


@query("E8_bound_caption_suppression", _el(", n AS (SELECT *, coalesce(lag(CASE WHEN type = 'caption' THEN text END) OVER w, lead(CASE WHEN type = 'caption' THEN text END) OVER w) AS own FROM el WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)) SELECT document_id, ordinal FROM n a WHERE type = 'caption' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.document_id = a.document_id AND b.type IN ('figure', 'table') AND trim(b.own) = trim(a.text))"))
def e8(spark, d):
    """A figure or table has the caption next to it as its own."""
    rows = elements(spark, d).withColumn("captions", F.filter(F.array(E.near_caption()), lambda c: c.isNotNull()))
    return E.without_bound_captions(rows).where("type = 'caption'").select("document_id", "ordinal")


@query("E9_heading_stack_path", _el(""", n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM el WHERE type = 'heading'),
h AS (SELECT document_id, ordinal, text, k + least(0, min(greatest(coalesce(level, 1), 1) - k) OVER (PARTITION BY document_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS depth FROM n),
up AS (SELECT a.document_id, a.ordinal, b.ordinal AS o, b.text FROM el a JOIN h b ON a.document_id = b.document_id AND b.ordinal < a.ordinal LEFT JOIN h own ON own.document_id = a.document_id AND own.ordinal = a.ordinal
       WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.document_id = a.document_id AND c.ordinal > b.ordinal AND c.ordinal < a.ordinal AND c.depth <= b.depth) AND (own.depth IS NULL OR b.depth < own.depth))
SELECT document_id, ordinal, string_agg(text, ' > ' ORDER BY o) AS path FROM up GROUP BY 1, 2"""))
def e9(spark, d):
    """The SQL has the stack's depth in closed form: a level, or one more than before if that is less."""
    return E.heading_paths(elements(spark, d), by_level=True).where("path <> ''")


@query("R1_heading_path_deepening", f"""WITH RECURSIVE {EL}, h AS (SELECT document_id, ordinal, text, coalesce(level, CASE WHEN regexp_matches(trim(text), '^\\d+(\\.\\d+)*\\s+\\S') THEN len(string_split(regexp_extract(trim(text), '^(\\d+(\\.\\d+)*)', 1), '.'))::INT END) AS rank, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM el WHERE type = 'heading'),
f AS (SELECT document_id, rn, ordinal, ''::VARCHAR AS above, [{{'r': coalesce(rank, 1), 't': text}}] AS stack FROM h WHERE rn = 1
  UNION ALL SELECT h.document_id, h.rn, h.ordinal, array_to_string(list_transform(k.kept, lambda x: x.t), ' > '), list_append(k.kept, {{'r': coalesce(h.rank, k.kept[-1].r + 1, 1), 't': h.text}})
  FROM f JOIN h ON h.document_id = f.document_id AND h.rn = f.rn + 1, LATERAL (SELECT CASE WHEN h.rank IS NULL THEN f.stack ELSE list_filter(f.stack, lambda x: x.r < h.rank) END AS kept) k)
SELECT e.document_id, e.ordinal, CASE WHEN e.type = 'heading' THEN coalesce(f.above, '') ELSE coalesce(array_to_string(list_transform(f.stack, lambda x: x.t), ' > '), '') END AS path
FROM el e ASOF LEFT JOIN f ON e.document_id = f.document_id AND e.ordinal >= f.ordinal""")
def r1(spark, d):
    """Levels where there are any, numbers else; the SQL keeps the stack as a list."""
    return E.heading_paths(elements(spark, d))


@query("E10_element_ids", _el(", n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM el WHERE type <> 'footnote') SELECT document_id, 'e' || lpad(rn::VARCHAR, greatest(4, length(rn::VARCHAR))::INT, '0') AS element_id, CASE WHEN type IN ('paragraph', 'list_item', 'caption', 'table', 'formula') THEN type || chr(10) || text ELSE text END AS search_text FROM n"))
def e10(spark, d):
    rows = elements(spark, d).where("type <> 'footnote'").withColumn("n", F.row_number().over(E.doc_order()))
    prefixed = F.when(F.col("type").isin("paragraph", "list_item", "caption", "table", "formula"), F.concat_ws("\n", "type", "text")).otherwise(F.col("text"))
    return rows.select("document_id", F.format_string("e%04d", "n").alias("element_id"), prefixed.alias("search_text"))


@query("E11_table_payload", """SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'order ' || l_orderkey || chr(10) ELSE '' END || string_agg('part: ' || l_partkey || ' | qty: ' || l_quantity::INT || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' | flag: ' || l_returnflag END, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS body FROM lineitem GROUP BY 1""")
def e11(spark, d):
    """Order lines are the rows of one table per order; even orders have a caption, flag N is no value."""
    headers = F.array(F.lit("part"), F.lit("qty"), F.lit("flag"))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "N", "NaN").otherwise(F.col("l_returnflag")))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", E.row_text(headers, cells).alias("line")).alias("r"))
    tables = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("rows"))
    caption = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    return tables.select("l_orderkey", E.table_text(caption, F.col("rows")).alias("body"))


@query("E12_caption_resolution", _el(", c AS (SELECT document_id, ordinal, lag(CASE WHEN type = 'caption' THEN text END) OVER w AS before, lead(CASE WHEN type = 'caption' THEN text END) OVER w AS after, type FROM el WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)) SELECT document_id, ordinal, coalesce(before, after, '') AS caption FROM c WHERE type IN ('figure', 'table')"))
def e12(spark, d):
    rows = elements(spark, d).select("document_id", "ordinal", "type", F.coalesce(E.near_caption(), F.lit("")).alias("caption"))
    return rows.where("type in ('figure', 'table')").drop("type")


@query("E13_document_stats", _el(" SELECT document_id, count(*) AS n_elements, coalesce(array_to_string(list_sort(list_distinct(list(page) FILTER (WHERE page IS NOT NULL))), ','), '') AS pages, count(*) FILTER (WHERE type = 'paragraph') AS n_paragraph FROM el GROUP BY 1"))
def e13(spark, d):
    rows = elements(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_elements"), F.array_sort(F.collect_set("page")).alias("p"), F.count_if(F.col("type") == "paragraph").alias("n_paragraph"))
    return rows.select("document_id", "n_elements", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"), "n_paragraph")


@query("A3_distinct_sorted_set", _el(" SELECT document_id, list_sort(list_distinct(list(type))) AS types FROM el GROUP BY 1"))
def a3(spark, d):
    return elements(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_set("type")).alias("types"))


@query("A1_count_per_group", _el(" SELECT document_id, type, count(*) AS n FROM el GROUP BY 1, 2"))
def a1(spark, d):
    return elements(spark, d).groupBy("document_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("A14_rollup_totals", _el(" SELECT document_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM el GROUP BY GROUPING SETS ((document_id), ())"))
def a14(spark, d):
    return elements(spark, d).rollup("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("A13_map_merge_sum", _el(", m AS (SELECT document_id, type, count(*) AS n FROM el GROUP BY 1, 2) SELECT type, sum(n)::BIGINT AS n, count(*) AS documents FROM m GROUP BY 1"))
def a13(spark, d):
    counts = elements(spark, d).groupBy("document_id", "type").count()
    maps = counts.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("m"))
    return maps.select(F.explode("m").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


@query("E14_sheet_anchor", "SELECT o_orderpriority AS sheet, 1 AS level, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def e14(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority is not null")
    return rows.groupBy(F.col("o_orderpriority").alias("sheet")).agg(F.lit(1).alias("level"), F.count(F.lit(1)).alias("n"))


@query("E15_figure_payload", _el(", c AS (SELECT document_id, ordinal, type, lag(CASE WHEN type = 'caption' THEN text END) OVER (PARTITION BY document_id ORDER BY ordinal) AS before FROM el) SELECT document_id, ordinal, coalesce(before, '[figure]') AS text, CASE WHEN before IS NULL THEN 0 ELSE 1 END AS n_captions FROM c WHERE type = 'figure'"))
def e15(spark, d):
    caption = F.lag(F.when(F.col("type") == "caption", F.col("text"))).over(E.doc_order())
    rows = elements(spark, d).withColumn("captions", F.filter(F.array(caption), lambda c: c.isNotNull())).where("type = 'figure'")
    return rows.select("document_id", "ordinal", F.coalesce(F.try_element_at("captions", F.lit(1)), F.lit("[figure]")).alias("text"), F.size("captions").alias("n_captions"))


_TOP = """, t AS (SELECT *, bool_or(label = 'title') OVER (PARTITION BY document_id) AS titled, min(level) FILTER (WHERE type = 'heading') OVER (PARTITION BY document_id) AS least FROM el),
top AS (SELECT *, CASE WHEN titled THEN label = 'title' WHEN least IS NOT NULL THEN type = 'heading' AND level IS NOT DISTINCT FROM least ELSE type = 'heading' END AS is_top FROM t)
"""


@query("P2_top_heading", _el(_TOP + "SELECT document_id, ordinal FROM top WHERE is_top"))
def p2(spark, d):
    return E.section_numbers(elements(spark, d)).where("top").select("document_id", "ordinal")


@query("P3_section_numbering", _el(_TOP + "SELECT document_id, ordinal, greatest(1, sum(is_top::INT) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM top"))
def p3(spark, d):
    return E.section_numbers(elements(spark, d)).select("document_id", "ordinal", "section")


@query("W3_running_counter", _el(" SELECT document_id, ordinal, sum((type = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM el"))
def w3(spark, d):
    return elements(spark, d).select("document_id", "ordinal", F.sum((F.col("type") == "heading").cast("int")).over(E.upto()).alias("so_far"))


_FILL = ", f AS (SELECT *, first_value(page IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, last_value(page IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS prv FROM el)"


@query("P4_page_gap_fill", _el(_FILL + " SELECT document_id, ordinal, coalesce(nxt, prv) AS page FROM f"))
def p4(spark, d):
    return elements(spark, d).select("document_id", "ordinal", E.fill_pages(F.col("page")).alias("page"))


@query("W4_forward_backward_fill", _el(_FILL + " SELECT document_id, ordinal, prv AS before, nxt AS after FROM f"))
def w4(spark, d):
    following = E.doc_order().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return elements(spark, d).select("document_id", "ordinal", F.last("page", ignorenulls=True).over(E.upto()).alias("before"), F.first("page", ignorenulls=True).over(following).alias("after"))


@query("P5_dispatch_per_format", _el(_TOP.replace("FROM el)", "FROM el WHERE document_id % 3 = 2)") + _FILL + """SELECT document_id, ordinal, page, 'page' AS page_kind FROM el WHERE document_id % 3 = 0
UNION ALL SELECT document_id, ordinal, coalesce(nxt, prv), 'slide' FROM f WHERE document_id % 3 = 1
UNION ALL SELECT document_id, ordinal, greatest(1, sum(is_top::INT) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))::INT, 'section' FROM top"""))
def p5(spark, d):
    """Every third document is a PDF, a slide deck, or a format numbered by sections."""
    rows = E.section_numbers(elements(spark, d)).withColumn("filled", E.fill_pages(F.col("page")))
    kind = F.element_at(F.array(F.lit("page"), F.lit("slide"), F.lit("section")), (F.col("document_id") % 3 + 1).cast("int"))
    page = F.when(F.col("document_id") % 3 == 0, F.col("page")).when(F.col("document_id") % 3 == 1, F.col("filled")).otherwise(F.col("section").cast("int"))
    return rows.select("document_id", "ordinal", page.alias("page"), kind.alias("page_kind"))


@query("P6_page_count", _el(" SELECT document_id, max(page) AS page_count FROM el GROUP BY 1"))
def p6(spark, d):
    return elements(spark, d).groupBy("document_id").agg(F.max("page").alias("page_count"))


@query("R2_numbered_depth", r"SELECT o_orderkey, len(string_split(regexp_extract(o_orderkey || '.' || o_custkey || ' x', '^(\d+(\.\d+)*)\s+\S', 1), '.'))::INT AS depth FROM orders")
def r2(spark, d):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.col("o_custkey").cast("string"), F.lit(" x"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", E.numbered_depth(text).alias("depth"))


_FLAGS = """, fl AS (SELECT *, coalesce(bool_or(type = 'heading' AND contains(lower(text), 'the')) OVER w, false) AS seen_abstract, coalesce(bool_or(type = 'heading' AND contains(lower(text), 'and')) OVER w, false) AS in_references FROM el WINDOW w AS (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Invented text has no such headings: 'the' stands for abstract, 'and' for references."""
    rows = elements(spark, d)
    marked = rows.withColumn("kept", F.col("text"))
    marked = marked.withColumn("text", F.when(F.col("type") == "heading", F.replace(F.replace(F.lower("text"), F.lit("the"), F.lit(" abstract ")), F.lit("and"), F.lit(" references "))).otherwise(F.col("text")))
    return E.flags(marked)


@query("R4_sticky_flags", _el(_FLAGS + " SELECT document_id, ordinal, seen_abstract, in_references FROM fl"))
def r4(spark, d):
    return _flagged(spark, d).select("document_id", "ordinal", "seen_abstract", "in_references")


@query("W1_running_flag", _el(" SELECT document_id, min(ordinal) AS first_heading, count(*) AS n FROM el WHERE type = 'heading' GROUP BY 1"))
def w1(spark, d):
    sticky = F.max((F.col("type") == "heading").cast("int")).over(E.upto())
    rows = elements(spark, d).withColumn("sticky", sticky).where("sticky = 1")
    return rows.groupBy("document_id").agg(F.min("ordinal").alias("first_heading"), F.count_if(F.col("type") == "heading").alias("n"))


_ROLES = _FLAGS + r""", ro AS (SELECT document_id, ordinal, CASE WHEN type = 'footnote' THEN 'footnote/skip' WHEN in_references AND type = 'list_item' THEN 'reference/drop' WHEN type = 'heading' AND contains(lower(text), 'and') THEN 'body/skip'
 WHEN NOT seen_abstract AND type = 'paragraph' AND regexp_matches(text, '(?i)\b(permission|license|creativecommons|grants permission)\b') THEN 'preamble/drop'
 WHEN NOT seen_abstract AND type = 'paragraph' AND (contains(text, '@') OR contains(text, 'University') OR contains(text, 'Google') OR length(text) < 8) THEN 'byline/skip' ELSE 'body/embed' END AS rp FROM fl)"""


@query("R3_role_policy", _el(_ROLES + " SELECT document_id, ordinal, rp FROM ro"))
def r3(spark, d):
    return E.roles(_flagged(spark, d)).select("document_id", "ordinal", F.concat_ws("/", "role", "index_policy").alias("rp"))


@query("R14_quality_counters", _el(_ROLES + " SELECT document_id, split_part(rp, '/', 1) AS role, count(*) AS n, count(*) FILTER (WHERE rp LIKE '%drop') AS dropped FROM ro GROUP BY 1, 2"))
def r14(spark, d):
    return E.roles(_flagged(spark, d)).groupBy("document_id", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("index_policy") == "drop").alias("dropped"))


@query("R5_formula_cleanup", r"""WITH f AS (SELECT l_orderkey, l_linenumber, 'MutiHead ( Q , K ) = ' || l_partkey || ' , ' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ' & & ( ' || l_linenumber || ' )' ELSE ' &' END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, 'MultiHead ( Q,K ) = ' || split_part(split_part(x, '= ', 2), ' ,', 1) || ',' || regexp_extract(x, ' , (\d+)[ &]', 1) AS text, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR END AS eq_label FROM f""")
def r5(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    tail = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" & & ( "), F.col("l_linenumber").cast("string"), F.lit(" )"))).otherwise(F.lit(" &"))
    latex = F.concat(F.lit("MutiHead ( Q , K ) = "), F.col("l_partkey").cast("string"), F.lit(" , "), F.col("l_suppkey").cast("string"), tail)
    return rows.select("l_orderkey", "l_linenumber", E.clean_formula(latex).alias("f")).select("l_orderkey", "l_linenumber", "f.*")


@query("R6_formula_context", _el(""", c AS (SELECT document_id, ordinal, type, last_value(CASE WHEN type = 'paragraph' THEN left(text, 300) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN type = 'paragraph' THEN left(text, 300) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM el) SELECT document_id, ordinal, before, after FROM c WHERE type = 'formula'"""))
def r6(spark, d):
    near = F.when(F.col("type") == "paragraph", F.substring("text", 1, 300))
    rows = elements(spark, d).select("document_id", "ordinal", "type", F.last(near, ignorenulls=True).over(E.before()).alias("before"), F.first(near, ignorenulls=True).over(E.after()).alias("after"))
    return rows.where("type = 'formula'").drop("type")


@query("W7_nearest_of_a_type", _el(" SELECT a.document_id, a.ordinal, max(b.ordinal) FILTER (WHERE b.ordinal < a.ordinal) AS previous, min(b.ordinal) FILTER (WHERE b.ordinal > a.ordinal) AS following FROM el a LEFT JOIN el b ON a.document_id = b.document_id AND b.type = 'heading' WHERE a.type = 'caption' GROUP BY 1, 2"))
def w7(spark, d):
    at = F.when(F.col("type") == "heading", F.col("ordinal"))
    rows = elements(spark, d).select("document_id", "ordinal", "type", F.max(at).over(E.before()).alias("previous"), F.min(at).over(E.after()).alias("following"))
    return rows.where("type = 'caption'").drop("type")


@query("R7_multi_value_cells", """WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN p_size || ' / ' || (p_size + 1) WHEN 2 THEN p_size || ' ' || (p_size + 2) WHEN 3 THEN p_brand ELSE ' ' END AS cell FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN replace(cell, ' / ', ';') WHEN 2 THEN replace(cell, ' ', ';') WHEN 3 THEN cell ELSE '' END AS vals FROM c""")
def r7(spark, d):
    p, n = spark.read.parquet(f"{d}/part.parquet"), F.col("p_size")
    case = F.col("p_partkey") % 5
    cell = F.when(case == 0, "-").when(case == 1, F.concat_ws(" / ", n, n + 1)).when(case == 2, F.concat_ws(" ", n, n + 2)).when(case == 3, F.col("p_brand")).otherwise(" ")
    return p.select("p_partkey", F.array_join(E.split_cell(cell), ";").alias("vals"))


@query("R8_table_forward_fill", "SELECT a.o_custkey, a.o_orderkey, arg_max(b.o_orderstatus, b.o_orderkey) AS first_cell FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey <= a.o_orderkey AND b.o_orderkey % 2 = 1 GROUP BY 1, 2")
def r8(spark, d):
    """A customer's orders are the rows of a table; the first cell of even ones is blank."""
    cell = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).otherwise(F.lit(""))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", E.filled_down(cell, ["o_custkey"], "o_orderkey").alias("first_cell"))
    return rows.where("first_cell <> ''")


@query("R9_table_facts", """SELECT l_orderkey, l_linenumber, '[table-fact] order ' || l_orderkey || ' | ' || l_returnflag || ' | ' || l_linestatus || ' | ' || h || ' | ' || v AS fact FROM (SELECT *, unnest(['qty', 'qty', 'col4']) AS h, unnest([l_quantity::INT::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR]) AS v FROM lineitem)""")
def r9(spark, d):
    """Unpivot: group, model, a cell of two values, and a cell without header."""
    text = lambda c: F.col(c).cast("int").cast("string")
    headers = F.array(F.lit(""), F.lit("Model"), F.lit("qty"))
    cells = F.array("l_returnflag", "l_linestatus", F.concat_ws(" / ", text("l_quantity"), text("l_linenumber")), text("l_partkey"))
    caption = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return E.table_facts(rows, caption, headers, cells).select("l_orderkey", "l_linenumber", "fact")


_BUDGET = ", b AS (SELECT document_id, ordinal, greatest(1, length(text) // 4) + 1 AS cost, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM el WHERE type = 'caption'), s AS (SELECT *, sum(cost) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS used FROM b)"


@query("R10_budgeted_prefix", _el(_BUDGET + " SELECT document_id, count(*) FILTER (WHERE rn = 1 OR used <= 40) AS taken, count(*) FILTER (WHERE rn > 1 AND used > 40) AS left_out FROM s GROUP BY 1"))
def r10(spark, d):
    rows = elements(spark, d).where("type = 'caption'").withColumn("fits", E.within_budget(E.tokens(F.col("text")) + 1, ["document_id"], ["ordinal"], 40))
    return rows.groupBy("document_id").agg(F.count_if("fits").alias("taken"), F.count_if(~F.col("fits")).alias("left_out"))


@query("W9_budget_prefix_sum", _el(_BUDGET + " SELECT document_id, ordinal, used::BIGINT AS used FROM s"))
def w9(spark, d):
    rows = elements(spark, d).where("type = 'caption'")
    return rows.select("document_id", "ordinal", F.sum((E.tokens(F.col("text")) + 1).cast("long")).over(E.upto()).alias("used"))


@query("R11_table_status", _el(" SELECT document_id, ordinal, CASE WHEN length(replace(replace(text, '|', ''), ' ', '')) = 0 THEN 'unparsed' WHEN length(text) - length(replace(text, ' | ', '  ')) < 2 THEN 'partial' ELSE 'parsed' END AS status FROM el WHERE type = 'table'"))
def r11(spark, d):
    cells = F.filter(F.transform(F.split("text", r" \| "), E.strip), lambda c: c != "")
    status = F.when(F.length(F.regexp_replace("text", r"[| ]", "")) == 0, "unparsed").when(F.size(F.split("text", r" \| ")) - 1 < 2, "partial").otherwise("parsed")
    return elements(spark, d).where("type = 'table'").withColumn("cells", cells).select("document_id", "ordinal", status.alias("status"))


@query("R12_figure_policy", _el(", c AS (SELECT document_id, ordinal, type, lag(type) OVER (PARTITION BY document_id ORDER BY ordinal) = 'caption' AS bound FROM el) SELECT document_id, ordinal, CASE WHEN coalesce(bound, false) THEN 'embed' ELSE 'skip' END AS index_policy, 'skipped_image' AS parse_status FROM c WHERE type = 'figure'"))
def r12(spark, d):
    bound = F.coalesce(F.lag("type").over(E.doc_order()) == "caption", F.lit(False))
    rows = elements(spark, d).withColumn("index_policy", F.when(bound, "embed").otherwise("skip")).where("type = 'figure'")
    return rows.select("document_id", "ordinal", "index_policy", F.lit("skipped_image").alias("parse_status"))


@query("R13_search_text", _el(""", s AS (SELECT *, 'd' || document_id AS path FROM el)
SELECT document_id, ordinal, CASE WHEN type = 'table' AND ordinal % 2 = 0 THEN left('cap' || chr(10) || text, 4000) WHEN type = 'table' THEN path || chr(10) || text WHEN type = 'formula' THEN path || chr(10) || '[formula] ' || CASE WHEN ordinal % 3 = 0 THEN '(1) ' ELSE '' END || text || chr(10) || 'before'
 WHEN type = 'figure' AND page IS NULL THEN '[image]' WHEN type = 'figure' THEN '[image] page=' || page ELSE text END AS search_text FROM s"""))
def r13(spark, d):
    """Even tables were not parsed; every third formula has a label."""
    even, third = F.col("ordinal") % 2 == 0, F.col("ordinal") % 3 == 0
    none = F.lit(None).cast("string")
    rows = elements(spark, d).withColumns({
        "parse_status": F.when(even, "unparsed").otherwise("parsed"), "caption": F.when(F.col("type") == "table", "cap"), "markdown": none, "latex": none,
        "eq_label": F.when(third, "1"), "context_before": F.lit("before"),
    })
    path = F.concat(F.lit("d"), F.col("document_id").cast("string"))
    return rows.select("document_id", "ordinal", E.search_text(path, none).alias("search_text"))


@query("P1_docx_page_alignment", "WITH l AS (SELECT doc_id AS document_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents) SELECT document_id, count(*) AS n FROM l WHERE trim(text) <> '' GROUP BY 1")
def p1(spark, d):
    """The source's units are the same lines with a page for every four: all are found in order."""
    from ..operators.alignment import align

    rows = lines(spark, d)
    out = align(rows, rows.withColumn("page", F.floor(F.col("ordinal") / 4) + 1)).join(rows, ["document_id", "ordinal"])
    good = out.where("trim(text) <> '' and accepted")
    return good.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("J9_forward_cursor_alignment", """WITH RECURSIVE l AS (SELECT doc_id AS document_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal, regexp_replace(trim(unnest(string_split(coalesce(text, ''), chr(10)))), '\\s+', ' ', 'g') AS key FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM l),
u AS (SELECT document_id, key, (ordinal // 4 + 1)::INT AS page, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM l WHERE ordinal % 5 <> 4 AND key <> ''),
f AS (SELECT d.document_id, 0::BIGINT AS rn, 0::BIGINT AS cursor, coalesce(u.page, 1) AS page, false AS found FROM (SELECT DISTINCT document_id FROM l) d LEFT JOIN u ON u.document_id = d.document_id AND u.k = 1
  UNION ALL SELECT e.document_id, e.rn, coalesce(h.k, f.cursor), coalesce(h.page, f.page), h.k IS NOT NULL FROM f JOIN e ON e.document_id = f.document_id AND e.rn = f.rn + 1
  LEFT JOIN LATERAL (SELECT min(u.k) AS k, arg_min(u.page, u.k) AS page FROM u WHERE u.document_id = e.document_id AND u.key = e.key AND u.k > f.cursor) h ON true)
SELECT f.document_id, e.ordinal, f.page, coalesce(sum(f.found::INT) OVER w / nullif(sum((e.key <> '')::INT) OVER w, 0) >= 0.5, false) AS accepted FROM f JOIN e USING (document_id, rn) WINDOW w AS (PARTITION BY f.document_id)""")
def j9(spark, d):
    """Every fifth unit is missing: its element keeps the page before."""
    from ..operators.alignment import align

    rows = lines(spark, d)
    units = rows.where("ordinal % 5 <> 4").withColumn("page", F.floor(F.col("ordinal") / 4) + 1)
    return align(rows, units)
