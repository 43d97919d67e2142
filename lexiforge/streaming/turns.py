"""Turn event streams: frames, the turn reducer, tool-call assembly, and event-time windows.

A turn is a state of its events: of a stored table it is aggregates, of a stream a state per turn
that is advanced batch by batch; both give the same turns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The events of a turn; the idle time after which a ping goes out.
EVENTS = ("turn_start", "tool_call", "tool_result", "answer_delta", "answer_reset", "gate_block", "turn_end", "error")
PING_S = 15
MAX_STEPS, MAX_BLOCKS = 6, 2
TURN = "turn_id long, answer string, calls int, results int, resets int, blocks int, state string"


def frames(raw: Column) -> Column:
    """array<struct<event, data>> of a raw stream that is stored whole: frames end at blank lines or at the
    end; comments, frames without data and data that is no JSON are skipped; the event without a name is
    message.  For streams in pieces see connections.py."""
    parts = F.filter(F.split(F.regexp_replace(raw, "\r\n", "\n"), "\n\n"), lambda p: (F.trim(p) != "") & ~p.startswith(":"))
    name = lambda p: F.trim(F.regexp_extract(p, r"(?m)^event:(.*)$", 1))
    data = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(?m)^data:(.*)$"), F.lit(1)), lambda t: F.trim(t)), "\n")
    made = F.transform(parts, lambda p: F.struct(F.when(p.rlike("(?m)^event:"), name(p)).otherwise("message").alias("event"), data(p).alias("data")))
    return F.filter(made, lambda f: F.try_parse_json(f["data"]).isNotNull())


def turns(events: DataFrame) -> DataFrame:
    """Batch: events (turn_id, seq, event, data, round, call_index) to one row per turn.

    The answer is the deltas after the last reset or end; a call is done once a later result has its
    round and index.  All of it is aggregates: one shuffle by turn, windows within it."""
    rows = events.select("turn_id", "seq", "event", F.coalesce("data", F.lit("")).alias("data"), "round", "call_index").repartition("turn_id")
    call = Window.partitionBy("turn_id", "round", "call_index")
    last = F.max(F.when(F.col("event") == "tool_result", F.col("seq"))).over(call)
    is_ = lambda *kinds: F.col("event").isin(*kinds)
    out = rows.withColumn("result_at", last).groupBy("turn_id").agg(
        F.array_sort(F.collect_list(F.when(is_("answer_delta"), F.struct("seq", "data")))).alias("deltas"),
        F.max(F.when(is_("answer_reset", "turn_end"), F.col("seq"))).alias("cut"),
        F.count_if(is_("tool_call")).cast("int").alias("calls"),
        F.count_if(is_("tool_call") & (F.col("result_at") > F.col("seq"))).cast("int").alias("results"),
        F.count_if(is_("answer_reset")).cast("int").alias("resets"),
        F.count_if(is_("gate_block")).cast("int").alias("blocks"),
        F.when(F.bool_or(is_("turn_end")), "done").when(F.bool_or(is_("error")), "failed").otherwise("open").alias("state"),
    )
    kept = F.filter("deltas", lambda s: F.col("cut").isNull() | (s["seq"] > F.col("cut")))
    return out.select("turn_id", F.array_join(F.transform(kept, lambda s: s["data"]), "").alias("answer"), "calls", "results", "resets", "blocks", "state")


STATE = ("answer", "open_calls", "calls", "results", "resets", "blocks", "state")


def advanced(turn: dict, rows: pd.DataFrame) -> dict:
    """The turn after a batch of its events, in the order of their numbers."""
    turn = dict(turn)
    waiting = {tuple(k): n for *k, n in json.loads(turn["open_calls"])}
    for event, data, *at in rows.sort_values("seq")[["event", "data", "round", "call_index"]].itertuples(index=False):
        key = tuple(None if pd.isna(x) else int(x) for x in at)
        match event:
            case "answer_delta":
                turn["answer"] += data or ""
            case "answer_reset" | "turn_end":
                turn["answer"] = ""
                turn["resets"] += event == "answer_reset"
                turn["state"] = "done" if event == "turn_end" else turn["state"]
            case "tool_call":
                turn["calls"] += 1
                waiting[key] = waiting.get(key, 0) + 1
            case "tool_result":
                turn["results"] += waiting.pop(key, 0)
            case "gate_block":
                turn["blocks"] += 1
            case "error":
                turn["state"] = "failed" if turn["state"] == "open" else turn["state"]
    return {**turn, "open_calls": json.dumps([[*k, n] for k, n in waiting.items()])}


def stream_turns(events: DataFrame, ping: bool = True) -> DataFrame:
    """Stream: the same turns from a state per turn; a turn is sent on when it ends, and with ping also
    whenever it has been idle for PING_S seconds (state: open).  Without ping a query over what is
    available now can end."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn = dict(zip(STATE, state.get, strict=True)) if state.exists else dict(zip(STATE, ("", "[]", 0, 0, 0, 0, "open"), strict=True))
        was_open, timed_out = turn["state"] == "open", state.hasTimedOut
        if not timed_out:
            turn = advanced(turn, pd.concat(list(pdfs)))
            state.update(tuple(turn.values()))
        if ping:
            state.setTimeoutDuration(PING_S * 1000)
        if timed_out or (was_open and turn["state"] != "open"):
            yield pd.DataFrame([{"turn_id": key[0], **{k: v for k, v in turn.items() if k != "open_calls"}}])

    kept = "answer string, open_calls string, calls int, results int, resets int, blocks int, state string"
    return events.groupBy("turn_id").applyInPandasWithState(step, TURN, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if ping else GroupStateTimeout.NoTimeout)


def partial_answer(raw: Column) -> Column:
    """The answer field of a JSON text that may end anywhere; empty without one.

    Escaped characters are masked, so the first quote left is the end; an escape that the end of the
    text cuts off is dropped."""
    rest = F.regexp_extract(raw, r'(?s)"answer"\s*:\s*"(.*)$', 1)
    masked = F.regexp_replace(rest, r"(?s)\\[^u]", "xx")
    end = F.locate('"', masked)
    left = F.length(F.regexp_replace(masked, r"\\(u[0-9a-fA-F]{0,3})?$", ""))
    body = F.substring(rest, F.lit(1), F.when(end > 0, end - 1).otherwise(left))
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"a":"'), body, F.lit('"}')), "$.a"), body, F.lit(""))


def assembled_calls(deltas: DataFrame) -> DataFrame:
    """deltas (turn_id, index, seq, id, name, part) to whole calls (turn_id, index, id, name, arguments): the last
    id and name that were sent, empty if none was, and the joined arguments; an empty object where
    those are none or broken."""
    parts = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("seq", "part"))))
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit(""))
    rows = deltas.groupBy("turn_id", "index").agg(last("id").alias("id"), last("name").alias("name"), F.array_join(F.transform(parts, lambda s: s["part"]), "").alias("raw"))
    whole = F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise("{}")
    return rows.select("turn_id", "index", "id", "name", whole.alias("arguments"))


def gate(mode: Column, searched: Column, evidence: Column, material: Column, blocks: Column) -> Column:
    """pass, block or fail of an answer.  Questions that are not about the material pass.  Deep turns
    need evidence, and fail at the last of MAX_BLOCKS blocks; others are blocked once if nothing was
    searched."""
    deep = F.when(evidence | ~material, "pass").when(blocks + 1 >= MAX_BLOCKS, "fail").otherwise("block")
    return F.when(mode == "deep", deep).when((blocks == 0) & material & ~searched, "block").otherwise("pass")


def replay(trace: DataFrame) -> DataFrame:
    """trace (turn_id, round, mode, material, answered, searched, evidence) to how each turn's loop ended:
    (turn_id, rounds, blocks, evidence, reason).

    What a round sees is a running maximum of the rounds before; blocks before it are a running count of
    answers that lack what their mode asks for.  The first answer that passes or fails ends the turn."""
    w = Window.partitionBy("turn_id").orderBy("round")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bool_or(c).over(earlier), F.lit(False))
    rows = trace.withColumn("number", F.row_number().over(w)).where(F.col("number") <= MAX_STEPS)
    rows = rows.withColumn("had_search", before("searched")).withColumn("had_evidence", before("evidence"))
    short = F.col("answered") & F.col("material") & ~F.when(F.col("mode") == "deep", F.col("had_evidence")).otherwise(F.col("had_search"))
    rows = rows.withColumn("short", short).withColumn("blocked", F.coalesce(F.count_if("short").over(earlier), F.lit(0)))
    verdict = F.when(F.col("answered"), gate(F.col("mode"), F.col("had_search"), F.col("had_evidence"), F.col("material"), F.col("blocked")))
    rows = rows.withColumn("verdict", verdict)
    ends = F.min(F.when(F.col("verdict").isin("pass", "fail"), F.col("number"))).over(Window.partitionBy("turn_id"))
    rows = rows.withColumn("ends", ends).where("ends is null or number <= ends")
    out = rows.groupBy("turn_id").agg(F.max("number").alias("rounds"), F.count_if(F.col("verdict").isin("block", "fail")).cast("int").alias("blocks"), F.bool_or(F.col("had_evidence") | (F.col("evidence") & ~F.col("answered"))).alias("evidence"), F.max_by("verdict", "number").alias("last"))
    reason = F.when(F.col("last") == "pass", "answered").when(F.col("last") == "fail", "no_evidence_after_gate").when(F.col("rounds") >= MAX_STEPS, "max_steps_without_answer").otherwise("open")
    return out.select("turn_id", "rounds", "blocks", "evidence", reason.alias("reason"))


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window; late events within the watermark still count.  An
    extension of ours; the same plan runs on a batch and on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
