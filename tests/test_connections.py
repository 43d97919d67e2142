"""Frames and tool calls in pieces against the whole stream."""

import json
import random
import time

import pytest

from lexiforge.streaming import connections as C

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunk(*calls, content=None):
    made = [{"index": i, "id": d, "function": {"name": n, "arguments": a}} for i, d, n, a in calls]
    return "data: " + json.dumps({"choices": [{"delta": {"content": content, "tool_calls": made}}]}, ensure_ascii=False)


STREAM = "\r\n\r\n".join([
    ": ping", "event: turn_start\r\ndata: {\"q\": \"é数😀\"}", chunk((0, "c1", "search", '{"q": ')), chunk((1, "c2", None, '{"brok'), (0, None, None, '"数"}')),
    "event: empty", "data: [DONE]", "event: two\r\ndata: {\"a\":\r\ndata: 1}", chunk((1, None, "read", "en"), (2, "c3", "none", None)), chunk(content="tail"),
]).replace("\r\n", "\n", 3) + "\r\n\r\nevent: unfinished\r\ndata: 1"
RAW = STREAM.encode()


def whole(raw):
    frames, tail = C.take_frames(b"", raw)
    calls = {}
    for _, data in frames:
        for index, *part in C.call_parts(data):
            calls[index] = C.merged(calls.get(index, ("", "", "")), tuple(part))
    return frames, {k: (d, n, C.arguments_of(a)) for k, (d, n, a) in calls.items()}


def test_the_whole_stream():
    frames, calls = whole(RAW)
    assert [e for e, _ in frames] == ["turn_start", "message", "message", "two", "message", "message"]
    assert json.loads(frames[0][1]) == {"q": "é数😀"} and json.loads(frames[3][1]) == {"a": 1}
    assert calls == {0: ("c1", "search", '{"q": "数"}'), 1: ("c2", "read", "{}"), 2: ("c3", "none", "{}")}


def test_a_cut_at_any_byte_changes_nothing():
    want = C.take_frames(b"", RAW)
    for at in range(len(RAW) + 1):
        first, tail = C.take_frames(b"", RAW[:at])
        second, tail = C.take_frames(tail, RAW[at:])
        assert (first + second, tail) == want
    tail, got = b"", []
    for k in range(len(RAW)):
        found, tail = C.take_frames(tail, RAW[k : k + 1])
        got += found
    assert (got, tail) == want


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


SCHEMA = "conn_id string, seq long, piece binary, closed boolean"


def start(spark, path, name, trigger, **kw):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return C.stream_connections(source, **kw).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(**trigger).start()


def test_pieces_over_micro_batches(rocks, tmp_path):
    """Cut anywhere, spread over batches and partly out of order."""
    rnd = random.Random(2)
    rows = []
    for c in range(6):
        cuts = sorted(rnd.sample(range(len(RAW)), 5 + c))
        pieces = [RAW[a:b] for a, b in zip([0, *cuts], [*cuts, len(RAW)], strict=True)]
        rows += [(f"c{c}", k, p, k + 1 == len(pieces)) for k, p in enumerate(pieces)]
    rnd.shuffle(rows)
    for part in range(3):
        rocks.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start(rocks, tmp_path, "pieces_out", {"availableNow": True}, ping_ms=None).awaitTermination()
    got = rocks.table("pieces_out").collect()
    frames, calls = whole(RAW)
    for c in range(6):
        mine = sorted((r for r in got if r["conn_id"] == f"c{c}"), key=lambda r: r["n"])
        assert [(r["event"], r["data"]) for r in mine if r["kind"] == "frame"] == frames
        assert {r["call_index"]: (r["call_id"], r["name"], r["data"]) for r in mine if r["kind"] == "call"} == calls
        assert mine[-1]["kind"] == "end" and len(mine) == len(frames) + len(calls) + 1


def test_idle_connections_are_pinged_and_expire(rocks, tmp_path):
    rows = [("open", 0, RAW[:70], False), ("shut", 0, RAW, True)]
    rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = start(rocks, tmp_path, "idle_out", {"processingTime": "200 milliseconds"}, ping_ms=400, expire_ms=20_000)
    try:
        until = time.time() + 90
        while time.time() < until and not any(r["kind"] == "expired" for r in rocks.table("idle_out").collect()):
            time.sleep(0.5)
            assert q.exception() is None
    finally:
        q.stop()
    got = [r for r in rocks.table("idle_out").collect()]
    kinds = [r["kind"] for r in got if r["conn_id"] == "open"]
    assert kinds[-1] == "expired" and kinds.count("ping") >= 1 and kinds[0] == "frame"
    assert not {"ping", "expired"} & {r["kind"] for r in got if r["conn_id"] == "shut"}
