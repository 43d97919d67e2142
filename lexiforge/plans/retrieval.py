"""Retrieval queries over the driver's vectors, with the SQL that checks them.

A vector is a chunk; its label is its document.  Every vector whose id is divisible by 20 makes a
request of two texts: itself (channel 0) and the next vector (channel 1).  Odd requests are scoped to
labels 0-4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import as_int, query
from ..functions.storage import work_folder
from ..operators import retrieve as R
from ..operators.inverted import build as build_index
from ..operators.inverted import search as search_index
from ..operators.vectors import hashed_bow, norm, normalized, top_k

SCOPE = (0, 1, 2, 3, 4)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", normalized(F.col("embedding")).alias("v"))


def texts_of_requests(v: DataFrame) -> DataFrame:
    """(request_id, channel, v): channel 0 is the request's own vector, channel 1 the next one."""
    own = v.where("id % 20 = 0").select(F.col("id").alias("request_id"), F.lit(0).alias("channel"), "v")
    other = v.where("id % 20 = 1").select((F.col("id") - 1).alias("request_id"), F.lit(1).alias("channel"), "v")
    return own.unionByName(other)


def channels(spark: SparkSession, d: str, k: int = R.CANDIDATE_K) -> DataFrame:
    """(request_id, channel, rank, chunk_id, score).  The scope reaches the search before ranking."""
    v = vectors(spark, d)
    asked = texts_of_requests(v).withColumn("id", F.col("request_id") * 2 + F.col("channel"))
    odd = F.col("request_id") % 40 == 20
    inside = v.where(F.col("label").isin(*SCOPE))
    found = top_k(v, asked.where(~odd), k).unionByName(top_k(inside, asked.where(odd), k))
    return found.select(F.floor(F.col("query_id") / 2).alias("request_id"), (F.col("query_id") % 2).cast("int").alias("channel"), "rank", F.col("id").alias("chunk_id"), "score")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """What stands in for the chunks' metadata: a rule over the id."""
    k = F.col("vec_id")
    kind = F.when(k % 7 == 0, "table_summary").when(k % 7 == 1, "table_pack").when(k % 7 == 2, "formula").when(k % 7 == 3, "figure").otherwise("prose")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        k.alias("chunk_id"),
        F.col("label").cast("string").alias("document_id"),
        kind.alias("chunk_type"),
        F.when(k % 7 < 2, F.floor(k / 7).cast("string")).alias("table_id"),
        F.when(k % 7 == 3, k.cast("string")).alias("figure_id"),
        (k % 13).cast("int").alias("page"),
    )


ORACLE_CHANNELS = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT id AS request_id, 0 AS channel, e FROM v WHERE id % 20 = 0
      UNION ALL SELECT id - 1, 1, e FROM v WHERE id % 20 = 1),
sim AS (SELECT request_id, channel, v.id AS chunk_id,
               round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS score
        FROM q, v WHERE request_id % 40 <> 20 OR label BETWEEN 0 AND 4),
ch AS (SELECT * FROM (SELECT request_id, channel, row_number() OVER (PARTITION BY request_id, channel ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM sim) WHERE rank <= {k}),
"""
ORACLE_META = """
meta AS (SELECT vec_id AS chunk_id, label::VARCHAR AS document_id,
                CASE vec_id % 7 WHEN 0 THEN 'table_summary' WHEN 1 THEN 'table_pack' WHEN 2 THEN 'formula' WHEN 3 THEN 'figure' ELSE 'prose' END AS chunk_type,
                CASE WHEN vec_id % 7 < 2 THEN (vec_id // 7)::VARCHAR END AS table_id,
                CASE WHEN vec_id % 7 = 3 THEN vec_id::VARCHAR END AS figure_id, (vec_id % 13)::INT AS page FROM embeddings),
"""
ORACLE_FUSED = """
fs AS (SELECT request_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, max(score) AS best_score, count(*) AS n_channels,
              min(channel * 1000 + rank) AS seen FROM ch GROUP BY 1, 2),
fused AS (SELECT request_id, chunk_id, fused, best_score, n_channels, row_number() OVER (PARTITION BY request_id ORDER BY fused DESC, seen) AS fused_rank FROM fs),
"""


def _with(body: str, k: int = R.CANDIDATE_K, meta: bool = False, fused: bool = True) -> str:
    parts = ORACLE_CHANNELS.format(k=k) + (ORACLE_META if meta else "") + (ORACLE_FUSED if fused else "")
    return "WITH RECURSIVE" + parts + body.strip() if body.lstrip().startswith("z_") else "WITH" + parts + body.strip()


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The fused pool with its metadata; pos is the fused rank, tables are allowed every third time."""
    fused = R.fuse(channels(spark, d))
    rows = fused.join(metadata(spark, d), "chunk_id")
    return rows.select("request_id", "chunk_id", F.col("best_score").alias("score"), F.col("fused_rank").alias("pos"), "document_id", "chunk_type", "table_id", "figure_id", "page", (F.col("request_id") % 3 == 0).alias("allow_tables"))


ORACLE_POOL = """
pool AS (SELECT f.request_id, f.chunk_id, f.best_score AS score, f.fused_rank AS pos, m.document_id, m.chunk_type, m.table_id, m.figure_id, m.page, f.request_id % 3 = 0 AS allow_tables
         FROM fused f JOIN meta m USING (chunk_id)),
"""


@query("Q2_dense_top_k", as_int("rank", _with("x AS (SELECT 1) SELECT request_id, channel, rank, chunk_id, score FROM ch", fused=False)))
def q2(spark, d):
    return channels(spark, d)


@query("Q2_index_top_k", as_int("rank", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 15"""))
def q2_index(spark, d):
    """The same search through an inverted file of 32 lists: exact, as lists are skipped by a bound only."""
    v = vectors(spark, d)
    index = build_index(v, 32, work_folder(spark, "inverted"))
    return search_index(index, v.where("id % 20 = 0"), R.CANDIDATE_K)[0]


@query("J12_queries_by_vectors", _with("x AS (SELECT 1) SELECT request_id, channel, count(*) AS n, max(score) AS best, min(score) AS worst FROM ch GROUP BY 1, 2", fused=False))
def j12(spark, d):
    return channels(spark, d).groupBy("request_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("L1_top_k_per_query", as_int("rank", _with("x AS (SELECT 1) SELECT request_id, rank, chunk_id, score FROM ch WHERE channel = 0 AND rank <= 3", fused=False)))
def l1(spark, d):
    return channels(spark, d, 3).where("channel = 0").drop("channel")


@query("Q3_window_sizing", "SELECT vec_id AS request_id, CASE WHEN vec_id % 40 = 20 THEN least(greatest(vec_id % 60, 5) * 4, 200) ELSE greatest(vec_id % 60, 5) END AS window_k FROM embeddings WHERE vec_id % 20 = 0")
def q3(spark, d):
    k = F.col("vec_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet").where(k % 20 == 0)
    return e.select(k.alias("request_id"), R.window_size(k % 60, F.lit(R.FINAL_K), k % 40 == 20).cast("long").alias("window_k"))


@query("Q4_rank_fusion", as_int("fused_rank", _with("x AS (SELECT 1) SELECT * FROM fused")))
def q4(spark, d):
    return R.fuse(channels(spark, d))


@query("A12_rank_fusion_sum", _with("x AS (SELECT 1) SELECT request_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS total FROM ch GROUP BY 1", fused=False))
def a12(spark, d):
    return channels(spark, d).groupBy("request_id").agg(F.round(F.sum(1.0 / (R.RRF_K + F.col("rank"))), 9).alias("total"))


@query("W11_rank_in_channel", as_int("rank", _with("x AS (SELECT 1) SELECT request_id, channel, chunk_id, rank, rank = 1 AS leads FROM ch", fused=False)))
def w11(spark, d):
    return channels(spark, d).select("request_id", "channel", "chunk_id", "rank", (F.col("rank") == 1).alias("leads"))


@query("Q6_best_dense_score", _with("x AS (SELECT 1) SELECT request_id, chunk_id, max(score) AS best_score FROM ch GROUP BY 1, 2", fused=False))
def q6(spark, d):
    return R.fuse(channels(spark, d)).select("request_id", "chunk_id", "best_score")


@query("Q7_scope_safety_net", _with("x AS (SELECT 1) SELECT c.request_id, count(*) FILTER (WHERE m.document_id IN ('0','2','4')) AS kept, count(*) FILTER (WHERE m.document_id NOT IN ('0','2','4')) AS dropped FROM ch c JOIN meta m USING (chunk_id) GROUP BY 1", meta=True, fused=False))
def q7(spark, d):
    inside = F.col("document_id").isin("0", "2", "4")
    rows = channels(spark, d).join(metadata(spark, d), "chunk_id")
    return rows.groupBy("request_id").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query("Q8_eligibility", _with("x AS (SELECT 1) SELECT request_id, chunk_id, best_score FROM fused WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) AND best_score IS NOT NULL"))
def q8(spark, d):
    eligible = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id"))
    return R.fuse(channels(spark, d)).where("best_score is not null").join(eligible, "chunk_id", "left_semi").select("request_id", "chunk_id", "best_score")


_QUOTA = """z_a AS (SELECT request_id, chunk_id FROM ch WHERE channel = 0 AND rank = 1),
z_b AS (SELECT request_id, arg_min(chunk_id, rank) AS chunk_id FROM ch c WHERE channel = 1 AND NOT EXISTS (SELECT 1 FROM z_a WHERE z_a.request_id = c.request_id AND z_a.chunk_id = c.chunk_id) GROUP BY 1),
z_r AS (SELECT request_id, chunk_id, 1 AS position FROM z_a UNION ALL SELECT b.request_id, b.chunk_id, 1 + (SELECT count(*) FROM z_a WHERE z_a.request_id = b.request_id) FROM z_b b),
z_f AS (SELECT f.request_id, f.chunk_id, row_number() OVER (PARTITION BY f.request_id ORDER BY fused_rank) + (SELECT count(*) FROM z_r WHERE z_r.request_id = f.request_id) AS position
        FROM fused f WHERE NOT EXISTS (SELECT 1 FROM z_r WHERE z_r.request_id = f.request_id AND z_r.chunk_id = f.chunk_id)),
z_all AS (SELECT *, true AS reserved FROM z_r UNION ALL SELECT *, false FROM z_f)
"""


@query("Q5_quota_selection", _with(_QUOTA.replace("WHERE channel = 1 AND", "WHERE channel = 1 AND request_id % 3 <> 0 AND") + "SELECT request_id, position::INT AS position, chunk_id, reserved FROM z_all WHERE position <= 15"))
def q5(spark, d):
    """The second text of every third request has no slot of its own."""
    ch = channels(spark, d).withColumn("own_slot", (F.col("channel") == 0) | (F.col("request_id") % 3 != 0))
    return R.quota_select(R.fuse(ch), ch, R.CANDIDATE_K)


@query("U7_fill_up_merge", _with(_QUOTA + "SELECT request_id, position::INT AS position, chunk_id FROM z_all WHERE position <= 8"))
def u7(spark, d):
    """The same merge as a priority union: reserved first, then the fused order, without repeats."""
    ch = channels(spark, d)
    picked = R.quota_select(R.fuse(ch), ch, 2).where("reserved").select("request_id", "chunk_id", F.col("position").alias("place"))
    rest = R.fuse(ch).select("request_id", "chunk_id", (F.col("fused_rank") + 1000).alias("place"))
    first = picked.unionByName(rest).groupBy("request_id", "chunk_id").agg(F.min("place").alias("place"))
    out = first.withColumn("position", F.row_number().over(R.by_request().orderBy("place")))
    return out.where("position <= 8").select("request_id", "position", "chunk_id")


@query("Q11_table_gate", _with(ORACLE_POOL + """g AS (SELECT *, allow_tables OR chunk_type NOT LIKE 'table%' AS ok FROM pool),
h AS (SELECT *, sum(ok::INT) OVER (PARTITION BY request_id) = 0 AS reopened FROM g) SELECT request_id, chunk_id, chunk_type, reopened FROM h WHERE ok OR reopened""", meta=True))
def q11(spark, d):
    return R.table_gate(pool(spark, d)).select("request_id", "chunk_id", "chunk_type", "reopened")


@query("Q12_score_floor", _with(ORACLE_POOL + "t AS (SELECT request_id, max(score) AS top FROM pool GROUP BY 1) SELECT request_id, chunk_id, score FROM pool JOIN t USING (request_id) WHERE top <= 0 OR score >= 0.82::DOUBLE * top", meta=True))
def q12(spark, d):
    return R.score_floor(pool(spark, d)).select("request_id", "chunk_id", "score")


@query("W12_relative_to_max", _with("t AS (SELECT request_id, max(best_score) AS top FROM fused GROUP BY 1) SELECT request_id, chunk_id, round(best_score / top, 6) AS share FROM fused JOIN t USING (request_id)"))
def w12(spark, d):
    return R.fuse(channels(spark, d)).select("request_id", "chunk_id", F.round(F.col("best_score") / F.max("best_score").over(R.by_request()), 6).alias("share"))


_SLOT = """s AS (SELECT *, CASE WHEN chunk_type LIKE 'table%' THEN 'table:' || table_id WHEN chunk_type = 'figure' THEN 'figure:' || figure_id
      WHEN chunk_type = 'formula' THEN 'formula:' || document_id || ':' || page ELSE 'chunk:' || chunk_id END AS slot FROM pool),
"""


@query("W13_first_appearance_rank", as_int("slot_no", _with(ORACLE_POOL + _SLOT + "f AS (SELECT request_id, slot, min(pos) AS p FROM s GROUP BY 1, 2) SELECT request_id, slot, row_number() OVER (PARTITION BY request_id ORDER BY p) AS slot_no FROM f", meta=True)))
def w13(spark, d):
    rows = pool(spark, d).withColumn("slot", R.slot_key()).groupBy("request_id", "slot").agg(F.min("pos").alias("p"))
    return rows.select("request_id", "slot", F.dense_rank().over(R.by_request().orderBy("p")).alias("slot_no"))


@query("Q13_diversity_collapse", as_int("slot_no", _with(ORACLE_POOL + _SLOT + """f AS (SELECT request_id, slot, min(pos) AS p FROM s GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p) AS slot_no FROM f),
stop AS (SELECT request_id, max(p) FILTER (WHERE slot_no = 5) AS at FROM o GROUP BY 1),
head AS (SELECT s.request_id, o.slot, o.slot_no, s.chunk_id, s.chunk_type, s.score FROM o JOIN s ON s.request_id = o.request_id AND s.slot = o.slot AND s.pos = o.p WHERE slot_no <= 5),
pk AS (SELECT h.request_id, h.slot, arg_min(s.chunk_id, s.pos) AS chunk_id, arg_min(s.score, s.pos) AS score FROM head h JOIN s ON s.request_id = h.request_id AND s.slot = h.slot JOIN stop t ON t.request_id = h.request_id
       WHERE h.chunk_type = 'table_summary' AND s.chunk_type = 'table_pack' AND (t.at IS NULL OR s.pos < t.at) GROUP BY 1, 2)
SELECT h.request_id, h.slot_no, coalesce(pk.chunk_id, h.chunk_id) AS chunk_id, coalesce(pk.score, h.score) AS score FROM head h LEFT JOIN pk ON pk.request_id = h.request_id AND pk.slot = h.slot""", meta=True)))
def q13(spark, d):
    return R.diversify(pool(spark, d)).select("request_id", "slot_no", "chunk_id", "score")


@query("Q14_dense_top_insurance", as_int("position", _with(ORACLE_POOL + """sel AS (SELECT request_id, chunk_id, pos + 1 AS place FROM pool WHERE pos BETWEEN 2 AND 6),
top AS (SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS r FROM pool),
u AS (SELECT request_id, chunk_id, place FROM sel UNION ALL SELECT request_id, chunk_id, 0 FROM top WHERE r = 1 AND (request_id, chunk_id) NOT IN (SELECT request_id, chunk_id FROM sel))
SELECT * FROM (SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY place) AS position, place = 0 AS insured FROM u) WHERE position <= 5""", meta=True)))
def q14(spark, d):
    rows = pool(spark, d)
    selected = rows.where("pos between 2 and 6").withColumn("slot_no", F.col("pos") + 1)
    return R.insure_best(selected, rows).select("request_id", "chunk_id", "position", "insured")


@query("Q15_min_score", _with("""t AS (SELECT request_id, max(best_score) AS top FROM fused WHERE fused_rank > 1 GROUP BY 1),
c AS (SELECT request_id, top < 0.45 AS low_confidence, CASE WHEN top >= 0.45 THEN 0.45::DOUBLE ELSE round_even(0.82::DOUBLE * top, 4) END AS cut FROM t)
SELECT request_id, chunk_id, best_score AS score, low_confidence FROM fused JOIN c USING (request_id) WHERE fused_rank > 1 AND best_score >= cut"""))
def q15(spark, d):
    """The request's own vector (rank 1) is left out, so that the relative cut has work to do."""
    rows = R.fuse(channels(spark, d)).where("fused_rank > 1").select("request_id", "chunk_id", F.col("best_score").alias("score"))
    return R.min_score(rows).select("request_id", "chunk_id", "score", "low_confidence")


@query("Q16_neighbor_expansion", _with(ORACLE_POOL + """hit AS (SELECT * FROM pool WHERE chunk_type IN ('table_summary', 'table_pack', 'figure')),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id, coalesce('t' || table_id, 'f' || figure_id) ORDER BY pos) AS turn FROM hit)
SELECT o.request_id, o.chunk_id, coalesce(string_agg(n.vec_id::VARCHAR, ',' ORDER BY n.vec_id) FILTER (WHERE turn = 1), '') AS neighbors
FROM o LEFT JOIN embeddings n ON n.label::VARCHAR = o.document_id AND n.vec_id <> o.chunk_id AND abs(n.vec_id - o.chunk_id) <= 20 GROUP BY 1, 2""", meta=True))
def q16(spark, d):
    """Neighbours: chunks of the same document at most 20 ids away; once per table, then none."""
    hits = pool(spark, d).where(F.col("chunk_type").isin("table_summary", "table_pack", "figure"))
    once = F.row_number().over(Window.partitionBy("request_id", R.slot_key()).orderBy("pos")) == 1
    near = metadata(spark, d).select(F.col("chunk_id").alias("n_id"), F.col("document_id").alias("n_doc"))
    near_id = F.explode(F.sequence(F.col("chunk_id") - 20, F.col("chunk_id") + 20)).alias("n_id")
    asked = hits.withColumn("once", once).select("request_id", "chunk_id", "document_id", "once", near_id)
    rows = asked.join(near, "n_id", "left").where("n_id = chunk_id or n_doc = document_id")
    ids = F.array_sort(F.collect_list(F.when((F.col("n_id") != F.col("chunk_id")) & F.col("once"), F.col("n_id"))))
    return rows.groupBy("request_id", "chunk_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("neighbors"))


@query("Q21_diagnostics", _with(ORACLE_POOL + "x AS (SELECT 1) SELECT request_id, count(*) AS pool_size, count(*) FILTER (WHERE chunk_type LIKE 'table%') AS tables, max(score) AS best, bool_or(score < 0.45) AS has_low FROM pool GROUP BY 1", meta=True))
def q21(spark, d):
    return pool(spark, d).groupBy("request_id").agg(F.count(F.lit(1)).alias("pool_size"), F.count_if(R.is_table(F.col("chunk_type"))).alias("tables"), F.max("score").alias("best"), F.bool_or(F.col("score") < R.MIN_SCORE).alias("has_low"))


@query("J4_payload_join", _with("x AS (SELECT 1) SELECT f.request_id, f.chunk_id, m.document_id, m.chunk_type, m.page FROM fused f JOIN meta m USING (chunk_id) WHERE f.fused_rank <= 5", meta=True))
def j4(spark, d):
    best = R.fuse(channels(spark, d)).where("fused_rank <= 5")
    return best.join(metadata(spark, d), "chunk_id").select("request_id", "chunk_id", "document_id", "chunk_type", "page")


#: The whole chain's settings: other ratios than the defaults, so that every branch has rows.
CHAIN = R.Settings(floor_ratio=0.55, minimum=0.45, budget=300, table_budget=500)


def chain_requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, scope, allow_tables): every 20th vector asks; odd ones are scoped to labels 0-4, some to
    nothing, and every third allows tables."""
    k = F.col("vec_id")
    scope = F.when(k % 100 == 60, F.array().cast("array<string>")).when(k % 40 == 20, F.array(*(F.lit(str(s)) for s in SCOPE)))
    e = spark.read.parquet(f"{d}/embeddings.parquet").where(k % 20 == 0)
    return e.select(k.alias("request_id"), scope.alias("scope"), (k % 3 == 0).alias("allow_tables"))


def chain_channels(spark: SparkSession, d: str) -> DataFrame:
    """Two texts a request: the mean of 2, 4 or 8 vectors from the request's on, and that of the next ones,
    so that some requests reach the minimum score and others don't."""
    v = vectors(spark, d)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("request_id"), F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (F.floor(F.col("id") / 20) % 3 + 1).cast("int")).alias("n"))
    member = F.sequence(F.col("request_id"), F.col("request_id") + 2 * F.col("n") - 1)
    members = asked.select("request_id", "n", F.posexplode(member).alias("p", "id")).join(v.select("id", "v"), "id")
    sums = members.groupBy("request_id", (F.col("p") >= F.col("n")).cast("int").alias("channel")).agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(64))).alias("s"))
    texts = sums.select((F.col("request_id") * 2 + F.col("channel")).alias("id"), "request_id", normalized(F.col("s")).alias("v"))
    narrow = F.col("request_id") % 40 == 20
    inside = v.where(F.col("label").isin(*SCOPE))
    wide = R.SCOPED_TIMES * R.CANDIDATE_K
    found = top_k(v, texts.where(~narrow), R.CANDIDATE_K).unionByName(top_k(inside, texts.where(narrow), wide))
    return found.select(F.floor(F.col("query_id") / 2).alias("request_id"), (F.col("query_id") % 2).cast("int").alias("channel"), "rank", F.col("id").alias("chunk_id"), "score")


def chain_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks with texts and neighbours: prose stands at ids 4, 5 and 6 modulo 7."""
    k = F.col("chunk_id")
    prose = lambda *ids: F.filter(F.array(*ids), lambda i: i >= 0)
    week = k - k % 7
    return metadata(spark, d).withColumns({
        "content": F.concat(F.lit("text of "), k.cast("string"), F.repeat(F.lit(" and more"), (k % 40).cast("int"))),
        "pack": F.when(F.col("chunk_type") == "table_pack", 1).when(F.col("chunk_type") == "table_summary", 0),
        "prev_ids": prose(week - 1, week - 2), "next_ids": F.array(week + 4, week + 5, week + 6),
    })


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole retrieval chain for all requests."""
    out = R.retrieve(chain_requests(spark, d), chain_channels(spark, d), chain_chunks(spark, d), CHAIN)
    return out.select("request_id", "position", "chunk_id", F.round("fused", 6).alias("fused"), "score", "reopened", "insured", "low_confidence", F.array_join(F.transform(F.concat("prev_ids", "next_ids"), lambda i: i.cast("string")), ",").alias("neighbors"), F.col("window").isNotNull().alias("windowed"))


_CHAIN = f"""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
a AS (SELECT id AS request_id, [2, 4, 8][(id // 20 % 3 + 1)::INT] AS n FROM v WHERE id % 20 = 0),
m AS (SELECT request_id, CASE WHEN u.id >= request_id + n THEN 1 ELSE 0 END AS channel, unnest(u.e) AS x, generate_subscripts(u.e, 1) AS i FROM a JOIN u ON u.id BETWEEN request_id AND request_id + 2 * n - 1),
q AS (SELECT request_id, channel, list(s ORDER BY i) AS e FROM (SELECT request_id, channel, i, sum(x) AS s FROM m GROUP BY ALL) GROUP BY 1, 2),
sim AS (SELECT request_id, channel, u.id AS chunk_id, round(list_dot_product(q.e, u.e) / sqrt(list_dot_product(q.e, q.e)), 6) AS score FROM q, u WHERE request_id % 40 <> 20 OR label BETWEEN 0 AND 4),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, channel ORDER BY score DESC, chunk_id) AS rank FROM sim)
       WHERE rank <= CASE WHEN request_id % 40 = 20 OR request_id % 100 = 60 THEN 60 ELSE 15 END AND rank <= CASE WHEN request_id % 40 = 20 THEN 60 ELSE 15 END AND request_id % 100 <> 60),
{ORACLE_META.strip()} {ORACLE_FUSED.strip()}
z_a AS (SELECT request_id, chunk_id FROM ch WHERE channel = 0 AND rank = 1),
z_b AS (SELECT request_id, arg_min(chunk_id, rank) AS chunk_id FROM ch c WHERE channel = 1 AND NOT EXISTS (SELECT 1 FROM z_a WHERE z_a.request_id = c.request_id AND z_a.chunk_id = c.chunk_id) GROUP BY 1),
z_r AS (SELECT request_id, chunk_id, 1 AS pos FROM z_a UNION ALL SELECT request_id, chunk_id, 2 FROM z_b),
pool AS (SELECT * FROM (SELECT f.request_id, f.chunk_id, f.fused, f.best_score AS score, row_number() OVER (PARTITION BY f.request_id ORDER BY coalesce(z_r.pos, 2 + fused_rank)) AS pos, m.*  EXCLUDE (chunk_id)
         FROM fused f LEFT JOIN z_r ON z_r.request_id = f.request_id AND z_r.chunk_id = f.chunk_id JOIN meta m ON m.chunk_id = f.chunk_id) WHERE pos <= 15),
fl AS (SELECT *, CASE WHEN score = 0 THEN -1 ELSE score END AS dense, max(CASE WHEN score = 0 THEN -1 ELSE score END) OVER (PARTITION BY request_id) AS top FROM pool),
va AS (SELECT *, false AS wide FROM fl WHERE request_id % 3 = 0 OR chunk_type NOT LIKE 'table%' UNION ALL SELECT *, true FROM fl),
s AS (SELECT *, CASE WHEN chunk_type LIKE 'table%' THEN 'table:' || table_id WHEN chunk_type = 'figure' THEN 'figure:' || figure_id WHEN chunk_type = 'formula' THEN 'formula:' || document_id || ':' || page ELSE 'chunk:' || chunk_id END AS slot
      FROM va WHERE top <= 0 OR dense >= {CHAIN.floor_ratio}::DOUBLE * top),
fp AS (SELECT request_id, wide, slot, min(pos) AS p FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id, wide ORDER BY p) AS slot_no FROM fp),
stop AS (SELECT request_id, wide, max(p) FILTER (WHERE slot_no = 5) AS at FROM o GROUP BY ALL),
hd AS (SELECT s.*, o.slot_no FROM o JOIN s ON s.request_id = o.request_id AND s.wide = o.wide AND s.slot = o.slot AND s.pos = o.p WHERE slot_no <= 5),
pk AS (SELECT h.request_id, h.wide, h.slot, min(s.pos) AS pos FROM hd h JOIN s ON s.request_id = h.request_id AND s.wide = h.wide AND s.slot = h.slot JOIN stop t ON t.request_id = h.request_id AND t.wide = h.wide
       WHERE h.chunk_type = 'table_summary' AND s.chunk_type = 'table_pack' AND (t.at IS NULL OR s.pos < t.at) GROUP BY ALL),
dv AS (SELECT h.request_id, h.wide, h.slot_no, coalesce(k.pos, h.pos) AS pos FROM hd h LEFT JOIN pk k ON k.request_id = h.request_id AND k.wide = h.wide AND k.slot = h.slot),
op AS (SELECT request_id, count(*) FILTER (WHERE NOT wide) = 0 AS reopened FROM dv GROUP BY 1),
se AS (SELECT dv.request_id, reopened, slot_no, pos FROM dv JOIN op USING (request_id) WHERE wide = reopened),
bt AS (SELECT fl.request_id, arg_min(pos, (-dense, pos)) AS pos FROM fl JOIN op USING (request_id) WHERE request_id % 3 = 0 OR reopened OR chunk_type NOT LIKE 'table%' GROUP BY 1),
ins AS (SELECT request_id, pos, 0 AS slot_no FROM bt WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.request_id = bt.request_id AND se.pos = bt.pos)),
pi AS (SELECT * FROM (SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY slot_no) AS place, slot_no = 0 AS insured FROM (SELECT request_id, pos, slot_no FROM se UNION ALL SELECT * FROM ins)) WHERE place <= 5),
pp AS (SELECT pi.*, fl.* EXCLUDE (request_id, pos), max(score) OVER (PARTITION BY pi.request_id) AS high FROM pi JOIN fl USING (request_id, pos)),
mn AS (SELECT *, high < {CHAIN.minimum} AND round_even({CHAIN.floor_ratio}::DOUBLE * high, 4) <> 0 AS low FROM pp WHERE score >= CASE WHEN high >= {CHAIN.minimum} THEN {CHAIN.minimum}::DOUBLE ELSE round_even({CHAIN.floor_ratio}::DOUBLE * high, 4) END),
r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place) AS position, chunk_id, fused, score, reopened, insured AND row_number() OVER (PARTITION BY request_id ORDER BY place) = 1 AS insured, low, chunk_type, table_id, figure_id FROM mn JOIN op USING (request_id)),
near AS (SELECT *, chunk_type IN ('table_summary', 'table_pack', 'figure') AS st, row_number() OVER (PARTITION BY request_id, table_id ORDER BY position) AS turn FROM r),
wk AS (SELECT *, (SELECT max(vec_id) FROM embeddings) AS hi, chunk_id - chunk_id % 7 AS w, CASE WHEN st AND (table_id IS NULL OR turn = 1) THEN 1 ELSE 0 END AS has FROM near),
ids AS (SELECT *, CASE WHEN has = 0 THEN []::BIGINT[] ELSE list_filter([w - 1, w - 2], lambda i: i >= 0) END AS prev, CASE WHEN has = 0 THEN []::BIGINT[] ELSE list_filter([w + 4, w + 5], lambda i: i <= hi) END AS nxt FROM wk)
SELECT request_id, position, chunk_id, round(fused, 6) AS fused, score, reopened, insured, low AS low_confidence, array_to_string(list_concat(prev, nxt), ',') AS neighbors"""


@query("Q22_single_query_retrieve", as_int("position", _CHAIN + ", st AS windowed FROM ids"))
def q22(spark, d):
    return _flagship(spark, d)


@query("V4_validate_normalize", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS length, len(embedding) = 64 AS right_size FROM embeddings")
def v4(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"), (F.size("embedding") == 64).alias("right_size"))


@query("V1_hashed_embedding")
def v1(spark, d):
    """CRC-32 buckets have no DuckDB twin; the tests hold it against a brute-force version."""
    docs = spark.read.parquet(f"{d}/benchmark.parquet")
    return docs.select("item_id", hashed_bow(F.col("text")).alias("v"))


def _cue(c: Column) -> Column:
    return R.wants_tables(c)


@query("Q10_table_cue", rf"SELECT conv_id, turn, regexp_matches(text, '{R.TABLE_CUES}') AS wants_tables FROM conversations")
def q10(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", _cue(F.col("text")).alias("wants_tables"))


@query("Q1_query_validation", r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM conversations WHERE text IS NOT NULL),
k AS (SELECT conv_id, t, min(turn) AS turn, max(length(t)) AS n FROM c WHERE t <> '' GROUP BY 1, 2)
SELECT conv_id, least(count(*), 8) AS n_texts FROM k GROUP BY 1 HAVING max(n) <= 2000""")
def q1(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    texts = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    return texts.select("conv_id", R.valid_texts(F.col("texts")).alias("t")).where("t is not null").select("conv_id", F.size("t").cast("long").alias("n_texts"))
