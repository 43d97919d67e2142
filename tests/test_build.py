"""Incremental builds and the lock that they stand under."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import locks
from lexiforge.operators import build as B

PRINT = {"chunker_version": "1", "embedding_model": "lengths"}


def text_of(k, revision):
    kinds = ["paragraph", "heading", "paragraph", "figure", "table", "table", "formula", "paragraph"]
    return [(k, n, kinds[n % len(kinds)], f"line {n} of {k} in {revision} " + "word " * (n * 7 % 40)) for n in range(5 + k % 30)]


def library(spark, revisions):
    """(documents, elements) of {document: revision}."""
    docs = spark.createDataFrame([(k, r) for k, r in revisions.items()], "document_id long, revision string")
    lines = [row for k, r in revisions.items() for row in text_of(k, r)]
    return docs, spark.createDataFrame(lines, "document_id long, ordinal long, type string, text string")


def embed(tag, size=3):
    return lambda text: F.array(*[F.length(text).cast("double"), F.lit(float(tag))][: size - 1], *[F.lit(0.5)] * max(1, size - 2))


def rows_of(spark, root):
    state = B.published(spark, root)
    return {r["chunk_id"]: r.asDict() for r in B.read_chunks(spark, state).collect()}, state


def test_only_changed_documents_are_made_again(spark, tmp_path):
    root, whole = str(tmp_path / "index"), str(tmp_path / "whole")
    before = {k: "r1" for k in range(60)}
    first = B.build(*library(spark, before), root, PRINT, embed(1), buckets=16)
    assert first.previous is None and first.reasons == {"new_document": 60} and first.embedded_chunks == first.chunk_count > 60
    rows, _ = rows_of(spark, root)
    after = {k: r for k, r in before.items() if k != 7} | {3: "r2", 99: "r1"}
    second = B.build(*library(spark, after), root, PRINT, embed(2), buckets=16)
    assert second.previous == first.version and second.reasons == {"reused": 58, "revision_changed": 1, "new_document": 1, "deleted": 1}
    now, state = rows_of(spark, root)
    # Only the chunks of 3 and 99 were embedded, by the second embedder.
    assert {r["document_id"] for r in now.values() if r["v"][1] == 2.0} == {3, 99}
    assert second.embedded_chunks == sum(r["document_id"] in (3, 99) for r in now.values())
    # Only the buckets of 3, 7 and 99 were written; the others' files lie where they lay.
    hashed = {r["document_id"]: r["b"] for r in spark.range(100).select(F.col("id").alias("document_id"), B.bucket_of(F.col("id"), 16).alias("b")).collect()}
    assert second.written_buckets == {hashed[3], hashed[7], hashed[99]}
    assert {b for b, v in state.layout.items() if v == first.version} == set(range(16)) - second.written_buckets
    # The same rows as a build of all documents.
    B.build(*library(spark, after), whole, PRINT, embed(1), buckets=16)
    full, _ = rows_of(spark, whole)
    bare = lambda d: {k: {c: v for c, v in r.items() if c not in ("v", "made_in")} for k, r in d.items()}
    assert bare(now) == bare(full)
    counts = {r["document_id"]: r["chunk_count"] for r in B.read_documents(spark, state).collect()}
    assert counts == {k: sum(r["document_id"] == k for r in full.values()) for k in after}
    # Nothing changed: nothing is written, and the old version stays for its buckets.
    third = B.build(*library(spark, after), root, PRINT, embed(3), buckets=16)
    assert not third.written_buckets and not third.embedded_chunks and rows_of(spark, root)[0] == now
    assert sorted(n for n in os.listdir(root) if n.startswith("v")) == sorted([first.version, second.version, third.version])


def test_many_changed_documents_shuffle_prose_once(spark, tmp_path, monkeypatch):
    from lexiforge.operators import chunks

    docs, elements = library(spark, {k: "r1" for k in range(12)})
    B.build(docs, elements, str(tmp_path / "few"), PRINT, embed(1), buckets=4)
    want = set(rows_of(spark, str(tmp_path / "few"))[0])
    monkeypatch.setattr(B, "MAX_BROADCAST", 5)
    stray = library(spark, {k: "r1" for k in range(40, 50)})[1]
    B.build(docs, elements.unionByName(stray), str(tmp_path / "many"), PRINT, embed(1), buckets=4)
    assert set(rows_of(spark, str(tmp_path / "many"))[0]) == want
    # Nine of twelve are new, three stay.
    B.build(docs.where("document_id < 3"), elements, str(tmp_path / "many"), PRINT, embed(1), buckets=4)
    B.build(docs, elements, str(tmp_path / "many"), PRINT, embed(1), buckets=4)
    assert set(rows_of(spark, str(tmp_path / "many"))[0]) == want
    assert chunks.prose_chunks(elements)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_neighbours_and_structure_are_in_the_build(spark, tmp_path):
    root = str(tmp_path / "index")
    B.build(*library(spark, {25: "r1", 26: "r1"}), root, PRINT, embed(1), buckets=4)
    rows, state = rows_of(spark, root)
    kinds = {r["chunk_type"] for r in rows.values()}
    assert kinds == {"prose", "formula", "figure", "table_pack"}
    for r in rows.values():
        if r["chunk_type"] != "prose":
            prose = sorted((x["anchor"], x["chunk_id"]) for x in rows.values() if x["document_id"] == r["document_id"] and x["chunk_type"] == "prose")
            assert r["prev_ids"] == [c for a, c in prose if a < r["anchor"]][-2:]
            assert r["next_ids"] == [c for a, c in prose if a > r["anchor"]][:2]
    totals = {r["document_id"]: r for r in B.quality(B.read_chunks(spark, state)).collect()}
    assert totals[None]["chunks"] == len(rows) == totals[25]["chunks"] + totals[26]["chunks"]
    assert totals[25]["figure"] == sum(r["chunk_type"] == "figure" and r["document_id"] == 25 for r in rows.values())


def test_a_changed_fingerprint_or_dimension_reuses_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = {k: "r1" for k in range(12)}
    B.build(*library(spark, docs), root, PRINT, embed(1), buckets=4)
    again = B.build(*library(spark, docs), root, PRINT | {"chunker_version": "2"}, embed(2), buckets=4)
    assert again.reasons == {"fingerprint_changed": 12} and again.reused_chunks == 0
    wider = B.build(*library(spark, docs | {1: "r2"}), root, PRINT | {"chunker_version": "2"}, embed(3, 4), buckets=4)
    rows, state = rows_of(spark, root)
    assert wider.reused_chunks == 0 and {len(r["v"]) for r in rows.values()} == {4} and state.dimension == 4
    # More buckets: everything moves.
    assert B.build(*library(spark, docs), root, PRINT | {"chunker_version": "2"}, embed(3, 4), buckets=8).reused_chunks == 0


def test_lost_files_are_made_again(spark, tmp_path):
    import shutil

    root = str(tmp_path / "index")
    docs = {k: "r1" for k in range(20)}
    first = B.build(*library(spark, docs), root, PRINT, embed(1), buckets=4)
    rows, state = rows_of(spark, root)
    shutil.rmtree(f"{root}/{first.version}/chunks/bucket=2")
    second = B.build(*library(spark, docs), root, PRINT, embed(1), buckets=4)
    assert second.written_buckets == {2} and set(second.reasons) == {"reused", "chunks_unreadable"}
    strip = lambda d: {k: {c: v for c, v in r.items() if c != "made_in"} for k, r in d.items()}
    assert strip(rows_of(spark, root)[0]) == strip(rows)


def test_empty_and_emptied_libraries(spark, tmp_path):
    root = str(tmp_path / "index")
    assert B.build(*library(spark, {1: "r1"}), root, PRINT, embed(1), buckets=2).chunk_count > 0
    none = spark.createDataFrame([], "document_id long, revision string"), spark.createDataFrame([], "document_id long, ordinal long, type string, text string")
    gone = B.build(*none, root, PRINT, embed(1), buckets=2)
    assert gone.reasons == {"deleted": 1} and gone.chunk_count == 0
    back = B.build(*library(spark, {1: "r1"}), root, PRINT, embed(1), buckets=2)
    assert back.reasons == {"new_document": 1} and back.chunk_count > 0


def test_a_failed_build_leaves_the_published_version(spark, tmp_path):
    root = str(tmp_path / "index")
    first = B.build(*library(spark, {1: "r1"}), root, PRINT, embed(1), buckets=2)
    with pytest.raises(Exception, match="broken"):
        B.build(*library(spark, {1: "r2"}), root, PRINT, lambda text: F.raise_error(F.lit("broken")).cast("array<double>"), buckets=2)
    assert B.published(spark, root).version == first.version and not os.path.exists(f"{root}/.build.lock")
    assert [n for n in os.listdir(root) if n.startswith("v")] == [first.version]


def test_one_of_two_sessions_has_the_lock(spark, tmp_path):
    path = str(tmp_path / "x.lock")
    mine = locks.acquire(spark, path)
    with pytest.raises(locks.BuildBusy):
        locks.acquire(spark.newSession(), path)
    mine.release()
    with locks.acquire(spark, path, newest_token=41) as later:
        assert later.token == 42 and later.took_over is None
    assert not os.path.exists(path)


def held_by(**change):
    return json.dumps({"owner": "x", "host": "elsewhere", "pid": 1, "started_at": time.time(), "token": 6} | change)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("building", "unparseable"), ("[1]", "unparseable"), (held_by(started_at=0), "no_start_time"), (held_by(started_at=time.time() - 4000), "expired"),
        (held_by(host=locks.socket.gethostname(), pid=0), "holder_gone"), (held_by(), None), (held_by(host=locks.socket.gethostname(), pid=os.getpid()), None),
    ],
)
def test_takeover_reasons(spark, tmp_path, text, reason):
    path = tmp_path / "x.lock"
    path.write_text(text)
    if reason is None:
        with pytest.raises(locks.BuildBusy):
            locks.acquire(spark, str(path))
        return
    took = locks.acquire(spark, str(path))
    assert took.took_over == reason and took.token == (7 if text.startswith("{") else 1) and took.held()


def test_an_unreadable_lock_is_taken_over(spark, tmp_path):
    assert locks.stale_reason(None, time.time()) == "unreadable"
    (tmp_path / "x.lock").mkdir()
    took = locks.acquire(spark, str(tmp_path / "x.lock"))
    assert took.took_over == "unreadable" and took.held()


def test_a_holder_that_slept_cannot_publish(spark, tmp_path):
    root = str(tmp_path / "index")
    now = [1000.0]
    slow = locks.acquire(spark, f"{root}/.build.lock", clock=lambda: now[0])
    now[0] += 5000
    fast = locks.acquire(spark, f"{root}/.build.lock", clock=lambda: now[0])
    assert fast.took_over == "expired" and fast.token == slow.token + 1
    done = B.build(*library(spark, {1: "r1"}), root, PRINT, embed(1), buckets=2, lock=fast)
    with pytest.raises(locks.StaleToken):
        B.build(*library(spark, {1: "r9"}), root, PRINT, embed(1), buckets=2, lock=slow)
    assert B.published(spark, root).version == done.version
