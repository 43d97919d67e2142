"""Retrieval: fusion, quota, gates, floors, diversity, expansion and presentation.

Every operator works for many requests at once; request_id is in each key.  Ranked lists are long
tables with an explicit rank, and every order has an explicit tie-break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import written
from .elements import EDGE

#: Defaults of the retrieval settings.
CANDIDATE_K, FINAL_K, RRF_K, QUOTA = 15, 5, 60, 1
FLOOR_RATIO, MIN_SCORE = 0.82, 0.45
SCOPED_TIMES, WINDOW_CAP = 4, 200
MAX_CHARS, MAX_TEXTS = 2000, 8
NEIGHBOR_MIN, PRIMARY_RATIO = 120, 0.6
WINDOW_CHARS, TABLE_WINDOW_CHARS = 1200, 3000
#: Words by which a question asks for tables.
TABLE_CUES = (
    r"(?i)(table|bleu|sts|spearman|score|scores|exact\s*match|\bem\b|avg\.?|correlation|"
    r"表|分数|准确率|相关系数|基准|benchmark|\.?(csv|tsv|xlsx?|xlsm)\b)"
)

#: Scores of (question, passage) pairs.
Predict = Callable[[list[tuple[str, str]]], list[float]]


def by_request():
    return Window.partitionBy("request_id")


def window_size(candidate_k: Column, final_k: Column, scoped: Column) -> Column:
    """Candidates to fetch per text: wider, but capped, for a scoped request."""
    base = F.greatest(candidate_k, final_k)
    return F.when(scoped, F.least(base * SCOPED_TIMES, F.lit(WINDOW_CAP))).otherwise(base)


def valid_texts(texts: Column) -> Column:
    """Stripped, non-empty, distinct in first-seen order, at most MAX_TEXTS; null if one is too long."""
    clean = F.array_distinct(F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != ""))
    return F.when(~F.exists(clean, lambda t: F.length(t) > MAX_CHARS) & (F.size(clean) > 0), F.slice(clean, 1, MAX_TEXTS))


def fuse(channels: DataFrame, k: int = RRF_K, entries: bool = False) -> DataFrame:
    """(request_id, channel, rank, chunk_id, score) to (request_id, chunk_id, fused, best_score,
    n_channels, fused_rank): reciprocal-rank fusion, ties by the first channel and rank that saw it.
    With entries also the channels that found the chunk, each with its rank and own_slot."""
    more = [_entries(channels)] if entries else []
    out = channels.groupBy("request_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused"),
        F.max("score").alias("best_score"),
        F.count(F.lit(1)).alias("n_channels"),
        F.min(F.struct("channel", "rank")).alias("seen"),
        *more,
    )
    order = by_request().orderBy(F.desc("fused"), "seen")
    return out.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def _chosen(hits: Column, top_k: int, slots: int) -> Column:
    """Places of the chosen hits in hits, an array in fused order of structs with entries (channel, rank,
    own_slot): what each channel in turn reserves, then the rest in order, top_k at most."""
    flat = F.flatten(F.transform(hits, lambda h, i: F.transform(h["entries"], lambda e: F.struct(e["channel"], e["rank"], e["own_slot"], i.alias("at")))))
    asked = F.array_sort(F.filter(flat, lambda e: e["own_slot"]))
    start = F.struct(F.array().cast("array<int>").alias("picked"), F.lit(-1).alias("channel"), F.lit(0).alias("n"))

    def step(s: Column, e: Column) -> Column:
        n = F.when(e["channel"] == s["channel"], s["n"]).otherwise(0)
        takes = (n < slots) & (F.size(s["picked"]) < top_k) & ~F.array_contains(s["picked"], e["at"])
        return F.struct(F.when(takes, F.concat(s["picked"], F.array(e["at"]))).otherwise(s["picked"]).alias("picked"), e["channel"].cast("int").alias("channel"), (n + takes.cast("int")).alias("n"))

    reserved = F.aggregate(asked, start, step, lambda s: s["picked"])
    every = F.transform(hits, lambda _, i: i)
    return F.struct(F.size(reserved).alias("reserved"), F.slice(F.concat(reserved, F.array_except(every, reserved)), 1, top_k).alias("at"))


def _entries(channels: DataFrame) -> Column:
    """The channels that found a chunk, an aggregate: (channel, rank, own_slot)."""
    own = F.coalesce("own_slot", F.lit(True)) if "own_slot" in channels.columns else F.lit(True)
    return F.collect_list(F.struct("channel", "rank", own.alias("own_slot"))).alias("entries")


def quota_select(fused: DataFrame, channels: DataFrame, top_k: int, slots: int = QUOTA) -> DataFrame:
    """Each channel in turn reserves its best unused chunks; the fused order fills up.  A channel whose
    own_slot is false (a column that channels may have) reserves none.

    A request's candidates, at most MAX_TEXTS windows of them, are one array; what a channel takes
    depends on what earlier ones took, so a fold over it decides."""
    found = channels.groupBy("request_id", "chunk_id").agg(_entries(channels))
    rows = fused.select("request_id", "chunk_id", "fused_rank").join(found, ["request_id", "chunk_id"])
    hits = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "chunk_id", "entries"))).alias("hits"))
    picked = hits.withColumn("chosen", _chosen(F.col("hits"), top_k, slots))
    out = picked.select("request_id", "hits", "chosen.reserved", F.posexplode("chosen.at").alias("p", "at"))
    return out.select("request_id", (F.col("p") + 1).alias("position"), F.get("hits", F.col("at"))["chunk_id"].alias("chunk_id"), (F.col("p") < F.col("reserved")).alias("reserved"))


def rerank(questions: DataFrame, passages: DataFrame, top_k: int = FINAL_K) -> DataFrame:
    """Lexical overlap, the default scorer: questions (q, text) and passages (c, text) to (q, c, score,
    place), the top_k passages of each question by the share of its words that they have, ties by c.

    Only pairs with a common word are made.  The top_k passages of least c are added to each question
    with score 0, which fills up those that have fewer."""
    words = lambda: F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")
    sizes = questions.select("q", F.size(F.array_distinct(F.split(F.lower("text"), " "))).alias("n"))
    shared = questions.select("q", words()).join(passages.select("c", words()), "w").groupBy("q", "c").agg(F.count(F.lit(1)).alias("s"))
    ids = passages.select("c").distinct().orderBy("c").limit(top_k).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    few = sizes.join(F.broadcast(ids), F.lit(True)).select("q", F.explode("ids").alias("c"), F.lit(0).cast("long").alias("s"))
    every = shared.unionByName(few).groupBy("q", "c").agg(F.max("s").alias("s")).join(sizes, "q")
    rows = every.withColumn("score", F.round(F.col("s") / F.col("n"), 6))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("place") <= top_k).select("q", "c", "score", "place")


def run_variants(channels: DataFrame, variants: dict[str, tuple[int, ...]]) -> DataFrame:
    """channels to (variant, request_id, chunk_id, fused, fused_rank): each variant fuses its own
    channels, all in one job."""
    named = F.array(*(F.when(F.col("channel").isin(*kept), F.lit(name)) for name, kept in variants.items()))
    rows = channels.withColumn("variant", F.explode(F.array_compact(named)))
    rows = rows.withColumn("request_id", F.struct("variant", "request_id"))
    return fuse(rows).select("request_id.*", "chunk_id", "fused", "fused_rank")


def scripted_search(requests: DataFrame, documents: DataFrame, errors: dict[int, str], top_k: int = FINAL_K) -> DataFrame:
    """A stand-in adapter with fixed answers: requests (request_id, collection, call_no) to (request_id,
    error, ids), ids being the top_k documents (collection, document_id) of least id.  A call whose
    number has an error in the script returns that."""
    first = documents.withColumn("rn", F.row_number().over(Window.partitionBy("collection").orderBy("document_id"))).where(F.col("rn") <= top_k)
    held = first.groupBy("collection").agg(F.array_sort(F.collect_list("document_id")).alias("ids"))
    error = F.lit(None).cast("string")
    for call, code in errors.items():
        error = F.when(F.col("call_no") == call, code).otherwise(error)
    empty = F.array().cast(held.schema["ids"].dataType)
    rows = requests.join(held, "collection", "left").withColumn("error", error)
    return rows.select("request_id", "error", F.when(F.col("error").isNull(), F.coalesce("ids", empty)).otherwise(empty).alias("ids"))


def wants_tables(question: Column) -> Column:
    return question.rlike(TABLE_CUES.replace(r"\b", EDGE))


def is_table(chunk_type: Column) -> Column:
    return chunk_type.isin("table_summary", "table_pack")


def table_gate(pool: DataFrame) -> DataFrame:
    """pool (request_id, chunk_type, allow_tables, ...): tables go unless allowed, or unless nothing
    else is left."""
    open_ = F.col("allow_tables") | ~is_table(F.col("chunk_type"))
    left = F.count_if(open_).over(by_request())
    return pool.withColumn("reopened", left == 0).where(open_ | F.col("reopened"))


def score_floor(pool: DataFrame, ratio: float = FLOOR_RATIO) -> DataFrame:
    """Drops scores below ratio times the request's best, if that is above 0."""
    best = F.max("score").over(by_request())
    return pool.withColumn("best", best).where((F.col("best") <= 0) | (F.col("score") >= ratio * F.col("best"))).drop("best")


def slot_key() -> Column:
    """What takes one slot: a table, a figure, a page's formulas, or a chunk of prose."""
    return (
        F.when(F.coalesce("table_id", F.lit("")) != "", F.concat(F.lit("table:"), F.col("table_id")))
        .when(F.coalesce("figure_id", F.lit("")) != "", F.concat(F.lit("figure:"), F.col("figure_id")))
        .when(F.col("chunk_type") == "formula", F.concat_ws(":", F.lit("formula"), F.col("document_id"), F.col("page")))
        .otherwise(F.concat(F.lit("chunk:"), F.col("chunk_id")))
    )


def diversify(pool: DataFrame, final_k: int = FINAL_K) -> DataFrame:
    """One row per slot in order of first appearance, at most final_k slots.  A table's first pack
    takes the place of its summary, if it comes before the last slot is filled."""
    keyed = pool.withColumn("slot", slot_key())
    per_slot = Window.partitionBy("request_id", "slot")
    keyed = keyed.withColumn("first_pos", F.min("pos").over(per_slot))
    keyed = keyed.withColumn("slot_no", F.dense_rank().over(by_request().orderBy("first_pos"))).where(F.col("slot_no") <= final_k)
    stop = F.when(F.max("slot_no").over(by_request()) == final_k, F.max("first_pos").over(by_request())).otherwise(F.lit(2147483647))
    first_type = F.first("chunk_type").over(per_slot.orderBy("pos"))
    may = (F.col("pos") == F.col("first_pos")) | ((first_type == "table_summary") & (F.col("chunk_type") == "table_pack") & (F.col("pos") < stop))
    keyed = keyed.withColumn("may", may).where("may")
    pack_first = per_slot.orderBy(F.when(F.col("chunk_type") == "table_pack", 0).otherwise(1), "pos")
    best = keyed.withColumn("turn", F.row_number().over(pack_first)).where("turn = 1")
    return best.drop("may", "turn", "first_pos")


def insure_best(selected: DataFrame, pool: DataFrame, final_k: int = FINAL_K) -> DataFrame:
    """Puts the pool's best-scored row in front of a selection that lacks it."""
    ties = by_request().orderBy(F.desc("score"), "pos")
    best = pool.withColumn("turn", F.row_number().over(ties)).where("turn = 1").select("request_id", "chunk_id", "score", F.lit(0).alias("place"))
    missing = best.join(selected.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")
    rows = selected.select("request_id", "chunk_id", "score", F.col("slot_no").alias("place")).unionByName(missing)
    rows = rows.withColumn("position", F.row_number().over(by_request().orderBy("place")))
    return rows.where(F.col("position") <= final_k).withColumn("insured", F.col("place") == 0).drop("place")


def min_score(rows: DataFrame, minimum: float = MIN_SCORE, ratio: float = FLOOR_RATIO) -> DataFrame:
    """Scores of at least the minimum; where there are none, of ratio times the best, flagged."""
    enough = F.count_if(F.col("score") >= minimum).over(by_request()) > 0
    relative = F.bround(ratio * F.max("score").over(by_request()), 4)
    rows = rows.withColumn("low_confidence", ~enough).withColumn("cut", F.when(enough, F.lit(minimum)).otherwise(relative))
    return rows.where(F.col("score") >= F.col("cut"))


def omitted(what: str, count: Column) -> Column:
    return F.concat(F.lit(f"…[{what}省略 "), count.cast("string"), F.lit(" 字符]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(primary: Column, before: list[Column], after: list[Column], budget: Column | int) -> Column:
    """A window of at most ``budget`` characters with labels: the primary text first, then the nearest
    neighbours before and after in turn, while room for NEIGHBOR_MIN characters is left.

    before and after hold up to two texts each, the nearest first.  What is cut or left out leaves a
    marker with the characters omitted.  Without neighbours the marker comes on top of the budget."""
    label = "[primary]\n"
    total = budget if isinstance(budget, Column) else F.lit(budget)
    room = F.greatest(F.lit(0), total - len(label))
    near = [(kind, k + 1, F.coalesce(parts[k], F.lit(""))) for k in range(2) for kind, parts in (("prev", before), ("next", after)) if k < len(parts)]

    def cut(text: Column, size: Column, what: str) -> Column:
        return F.concat(F.substring(text, F.lit(1), size), F.when(F.length(text) > size, omitted(what, F.length(text) - size)).otherwise(""))

    def opened(own: Column) -> Column:
        whole = F.length(own) <= F.greatest(F.lit(1), F.floor(total * PRIMARY_RATIO))
        return F.concat(F.lit(label), cut(own, F.when(whole, F.length(own)).otherwise(F.least(F.length(own), room)), "本体"))

    def with_part(text: Column, part: Column, head: str) -> Column:
        left = total - 2 - len(head) - F.length(text)
        block = F.when(left < NEIGHBOR_MIN, omitted("邻居", F.length(part))).otherwise(F.concat(F.lit(head), cut(part, F.least(F.length(part), left), "邻居")))
        return F.when(part == "", text).otherwise(F.concat(text, F.lit("\n\n"), block))

    def around(text: Column, rest: list[tuple[str, int, Column]]) -> Column:
        if not rest:
            return F.substring(text, F.lit(1), total)
        kind, k, part = rest[0]
        return let(let(part, lambda p: with_part(text, p, f"[context:{kind} #{k}]\n")), lambda t: around(t, rest[1:]))

    any_near = F.lit(False)
    for _, _, part in near:
        any_near = any_near | (part != "")
    return let(F.coalesce(primary, F.lit("")), lambda own: F.when(any_near, let(opened(own), lambda t: around(t, near))).otherwise(F.concat(F.lit(label), cut(own, room, "本体"))))


@dataclass(frozen=True)
class Settings:
    """What a retrieval may be told; a floor_ratio or minimum of 0 turns that step off."""

    candidate_k: int = CANDIDATE_K
    final_k: int = FINAL_K
    quota: int = QUOTA
    floor_ratio: float = FLOOR_RATIO
    minimum: float = MIN_SCORE
    budget: int = WINDOW_CHARS
    table_budget: int = TABLE_WINDOW_CHARS


def _dense(score: Column) -> Column:
    """A best cosine as the floor and the insurance rank it: 0.0 counts like none."""
    return F.when(score == 0, F.lit(-1.0)).otherwise(score)


def _floored(pool: Column, ratio: float) -> Column:
    top = F.array_max(F.transform(pool, lambda h: h["dense"]))
    return F.filter(pool, lambda h: (F.lit(ratio <= 0) | (top <= 0) | (h["dense"] >= F.lit(float(ratio)) * top)))


def _collapsed(pool: Column, kind: str, allow: Column, final_k: int) -> Column:
    """The first hit of each slot in order, at most final_k; a pack takes the place of its summary, unless
    final_k slots are filled by then."""

    def step(kept: Column, h: Column) -> Column:
        held = F.exists(kept, lambda k: k["slot"] == h["slot"])
        better = F.transform(kept, lambda k: F.when((k["slot"] == h["slot"]) & (k["chunk_type"] == "table_summary") & (h["chunk_type"] == "table_pack"), h).otherwise(k))
        return F.when(F.size(kept) >= final_k, kept).when(held, better).otherwise(F.concat(kept, F.array(h)))

    open_ = F.filter(pool, lambda h: allow | ~is_table(h["chunk_type"]))
    return F.aggregate(open_, F.array().cast(kind), step)


def pooled(requests: DataFrame, channels: DataFrame, chunks: DataFrame, settings: Settings = Settings(), eligible: DataFrame | None = None) -> DataFrame:
    """The pool of each request in quota order: (request_id, pos, chunk_id, fused, score, document_id,
    chunk_type, slot).

    requests: request_id, allow_tables, scope (array of document ids; null for none).  channels: request_id,
    channel, rank, chunk_id, score, and own_slot if some texts have no slot of their own; ranks beyond
    the request's window do not count.  chunks: chunk_id, document_id, chunk_type, table_id, figure_id, page.
    A scope that is empty gives nothing; a chunk outside the scope is dropped even if the search found it."""
    window = window_size(F.lit(settings.candidate_k), F.lit(settings.final_k), F.col("scope").isNotNull())
    asked = requests.select("request_id", window.alias("window"), "scope")
    seen = channels.join(asked.select("request_id", "window"), "request_id").where(F.col("rank") <= F.col("window")).drop("window")
    fused = fuse(seen, entries=True).where("best_score is not null")
    facts = chunks.select("chunk_id", "document_id", "chunk_type", slot_key().alias("slot"))
    rows = fused.join(facts, "chunk_id").join(asked.select("request_id", "scope"), "request_id")
    rows = rows.where(F.col("scope").isNull() | F.array_contains("scope", F.col("document_id")))
    if eligible is not None:
        rows = rows.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
    hit = F.struct("fused_rank", "chunk_id", "fused", F.col("best_score").alias("score"), "document_id", "chunk_type", "slot", "entries")
    hits = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    places = _chosen(F.col("hits"), max(settings.final_k, settings.candidate_k), settings.quota)["at"]
    picked = hits.select("request_id", F.posexplode(F.transform(places, lambda i: F.get("hits", i))).alias("pos", "h"))
    return picked.select("request_id", (F.col("pos") + 1).alias("pos"), *(F.col(f"h.{c}").alias(c) for c in ("chunk_id", "fused", "score", "document_id", "chunk_type", "slot")))


def reranked(pool: DataFrame, requests: DataFrame, chunks: DataFrame, predict: Predict | None) -> DataFrame:
    """pool with order, the place after reranking, and reranked.

    predict takes lists of (question, passage) pairs of one batch and gives their scores.  Only the pool's
    pairs are scored.  Passages without text follow in pool order; where predict fails for a pair of a
    request, or a score is missing, that request keeps its pool order."""
    if predict is None:
        return pool.withColumns({"order": F.col("pos"), "reranked": F.lit(False)})
    pairs = pool.join(requests.select("request_id", "text"), "request_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    asked = pairs.select("request_id", "chunk_id", "text", F.when(~blank, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, passages = batch.column("text").to_pylist(), batch.column("content").to_pylist()
            full = [k for k, p in enumerate(passages) if p is not None]
            scores: list[float | None] = [None] * batch.num_rows
            try:
                for k, score in zip(full, predict([(texts[k], passages[k]) for k in full]) if full else [], strict=True):
                    scores[k] = float(score)
                failed = False
            except Exception:  # the scorer is the caller's: whatever it raises, the fused order stands
                failed, scores = True, [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), batch.column("chunk_id"), pa.array(scores, pa.float64()), pa.array([failed] * batch.num_rows)], ["request_id", "chunk_id", "pair_score", "failed"])

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    scored = asked.mapInArrow(run, f"request_id {kinds['request_id']}, chunk_id {kinds['chunk_id']}, pair_score double, failed boolean")
    rows = pool.join(scored, ["request_id", "chunk_id"], "left")
    ok = ~F.bool_or(F.coalesce("failed", F.lit(True))).over(by_request())
    rows = rows.withColumn("reranked", ok)
    place = by_request().orderBy(F.when(F.col("reranked"), F.col("pair_score")).desc_nulls_last(), "pos")
    return rows.withColumn("order", F.row_number().over(place)).drop("pair_score", "failed")


def selected(pool: DataFrame, requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A reranked pool to its results (request_id, position, chunk_id, fused, score, chunk_type, reopened,
    insured, low_confidence).

    Each step works on the array of one request's pool: the floor on best cosines, the table gate, one hit
    a slot, the gate opened if it leaves nothing, the best cosine of the pool that passes the gate in
    front, and the minimum, or where nothing reaches it the floor's share of the best, flagged."""
    k = settings.final_k
    item = F.struct("order", "pos", "chunk_id", "fused", "score", _dense(F.col("score")).alias("dense"), "chunk_type", "slot")
    rows = pool.withColumn("item", item)
    kind = f"array<{rows.schema['item'].dataType.simpleString()}>"
    rows = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("item")).alias("pool")).join(requests.select("request_id", "allow_tables"), "request_id")
    rows = rows.withColumn("floored", _floored(F.col("pool"), settings.floor_ratio))
    rows = rows.withColumn("gated", _collapsed(F.col("floored"), kind, F.col("allow_tables"), k))
    rows = rows.withColumn("reopened", F.size("gated") == 0)
    rows = rows.withColumn("picked", F.when(F.col("reopened"), _collapsed(F.col("floored"), kind, F.lit(True), k)).otherwise(F.col("gated")))
    may = F.filter("pool", lambda h: F.col("allow_tables") | F.col("reopened") | ~is_table(h["chunk_type"]))
    best = F.array_sort(F.transform(may, lambda h: F.struct((-h["dense"]).alias("d"), h["pos"].alias("p"), h.alias("h"))))
    rows = rows.withColumn("best", F.get(best, F.lit(0))["h"])
    missing = F.col("best").isNotNull() & ~F.exists("picked", lambda h: h["chunk_id"] == F.col("best")["chunk_id"])
    rows = rows.withColumn("insured", missing)
    rows = rows.withColumn("picked", F.when(missing, F.slice(F.concat(F.array("best"), F.col("picked")), 1, k)).otherwise(F.col("picked")))
    enough = F.filter("picked", lambda h: h["score"] >= settings.minimum)
    relative = F.bround(F.lit(float(settings.floor_ratio)) * F.array_max(F.transform("picked", lambda h: h["score"])), 4)
    demoted = F.lit(settings.minimum > 0 and settings.floor_ratio > 0) & (F.size(enough) == 0)
    rows = rows.withColumn("low", demoted & (relative != 0)).withColumn("cut", F.when(demoted, relative))
    kept = F.when(demoted, F.filter("picked", lambda h: h["score"] >= F.col("cut"))).otherwise(enough if settings.minimum > 0 else F.col("picked"))
    out = rows.select("request_id", "reopened", "insured", "low", F.col("best.chunk_id").alias("best_id"), F.posexplode(kept).alias("place", "h"))
    first = F.col("insured") & (F.col("h.chunk_id") == F.col("best_id"))
    return out.select("request_id", (F.col("place") + 1).alias("position"), "h.chunk_id", "h.fused", "h.score", "h.chunk_type", "reopened", first.alias("insured"), F.col("low").alias("low_confidence"))


def expanded(results: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """results with content, prev_ids, next_ids and window.  Tables and figures get a window: a table's body is
    all its chunks' distinct texts in pack order, and around it stand the hit's own up to two neighbours
    before and after (ids that chunks lack are left out).  Of the hits of one table in a request only the
    first has neighbours.  chunks: chunk_id, content, table_id, figure_id, pack, prev_ids, next_ids."""
    hits = results.join(chunks.select("chunk_id", "content", "table_id", "figure_id", "prev_ids", "next_ids"), "chunk_id")
    structural = is_table(F.col("chunk_type")) | (F.col("chunk_type") == "figure")
    in_table = F.coalesce("table_id", F.lit("")) != ""
    turn = F.row_number().over(Window.partitionBy("request_id", F.when(in_table, F.col("table_id"))).orderBy("position"))
    hits = hits.withColumn("structural", structural).withColumn("near", structural & (~in_table | (turn == 1)))
    ids = lambda c: F.slice(F.coalesce(c, F.array().cast(hits.schema["prev_ids"].dataType)), 1, 2)
    side = lambda c, after: F.transform(ids(F.col(c)), lambda i, k: F.struct(F.lit(after).alias("after"), k.alias("k"), i.alias("n_id")))
    asked = hits.where("near").select("request_id", F.col("chunk_id").alias("of"), F.explode(F.concat(side("prev_ids", False), side("next_ids", True))).alias("n")).select("request_id", "of", "n.*")
    found = asked.join(chunks.select(F.col("chunk_id").alias("n_id"), F.col("content").alias("n_text")), "n_id")
    part = lambda after: F.array_sort(F.collect_list(F.when(F.col("after") == after, F.struct("k", "n_id", "n_text"))))
    around = found.groupBy("request_id", F.col("of").alias("chunk_id")).agg(part(False).alias("before"), part(True).alias("after"))
    wanted = hits.where(F.col("structural") & in_table).select("table_id").distinct()
    shards = chunks.where(in_table).join(wanted, "table_id", "left_semi").where("coalesce(content, '') <> ''")
    # Summaries (pack null or 0) stand behind the packs.
    pack = F.coalesce(F.nullif("pack", F.lit(0)), F.lit(-1))
    bodies = shards.groupBy("table_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pack.alias("p"), "chunk_id", "content"))), lambda s: s["content"])).alias("texts"))
    rows = hits.join(around, ["request_id", "chunk_id"], "left").join(bodies, "table_id", "left")
    own = F.coalesce("content", F.lit(""))
    whole = F.when((own != "") & ~F.array_contains("texts", own), F.concat("texts", F.array(own))).otherwise(F.col("texts"))
    primary = F.when(F.col("structural") & in_table & F.col("texts").isNotNull(), F.array_join(whole, "\n\n")).otherwise(own)
    texts = lambda c: [F.get(c, F.lit(k))["n_text"] for k in range(2)]
    rows = rows.withColumn("primary", primary)
    budget = F.when(in_table, F.lit(settings.table_budget)).otherwise(F.lit(settings.budget))
    window = F.when(F.col("structural"), present(F.col("primary"), texts("before"), texts("after"), budget))
    names = lambda c: F.coalesce(F.transform(c, lambda s: s["n_id"]), F.array().cast(hits.schema["prev_ids"].dataType))
    return rows.select(*results.columns, "content", names("before").alias("prev_ids"), names("after").alias("next_ids"), window.alias("window"))


def retrieve(
    requests: DataFrame, channels: DataFrame, chunks: DataFrame, settings: Settings = Settings(), predict: Predict | None = None, eligible: DataFrame | None = None,
) -> DataFrame:
    """The whole chain for many requests at once: window, fusion, scope, eligibility, quota, reranking of
    the pool, floor, gate, diversity, insurance, minimum, neighbours and windows.  See pooled, reranked,
    selected and expanded for the tables' columns."""
    pool = reranked(pooled(requests, channels, chunks, settings, eligible), requests, chunks, predict)
    # A few rows a request; three joins look up what stands around them.
    return expanded(written(selected(pool, requests, settings), "results"), chunks, settings)


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """The default scorer: the share of the question's words that the passage has."""
    out = []
    for question, passage in pairs:
        asked = set(question.lower().split())
        out.append(round(len(asked & set(passage.lower().split())) / len(asked), 6) if asked else 0.0)
    return out
