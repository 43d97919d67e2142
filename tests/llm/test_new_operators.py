"""Importance resampling, shards by bytes and repair of turns against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexiforge.llm import audit, importance, ngrams, sharding, turn_repair

from .helpers import SPACE, frame, odd_rows, text_maker


def test_xxh64_equals_the_library():
    rnd = random.Random(3)
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(4000)) + bytes(8), np.uint8).copy()
    at = np.array([rnd.randrange(3000) for _ in range(2000)])
    length = np.array([rnd.choice([rnd.randrange(40), rnd.randrange(700)]) for _ in at])
    got = ngrams.xxh64(data, at, length)
    assert all(int(h) == xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for h, a, n in zip(got, at, length, strict=True))


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


TEXTS = ["", "One one ONE", "é-è a1b2 éé", "x" * 900 + " " + "x" * 900 + " y", "end", "end of line\nnext", "İstanbul ßß 数 数 数", " .,; ", "a" * 32 + " " + "b" * 31]


@pytest.mark.parametrize("run", [4, 1 << 18])
def test_tables_count_every_gram(monkeypatch, run):
    monkeypatch.setattr(ngrams, "MAX_GRAMS", run)
    words = ngrams.words_of(pa.array(TEXTS))
    per_row, buckets = Counter(), Counter()
    for table, rows in ngrams.tables(words, 2, 97):
        for row, slot in zip(rows.tolist(), table.slot.tolist(), strict=True):
            per_row[row] += 1
            buckets[int(table.bucket[slot])] += 1
        assert table.count.sum() == len(rows)
    assert per_row == {k: len(grams(t)[1]) for k, t in enumerate(TEXTS) if grams(t)[1]}
    assert buckets == Counter(zlib.crc32(g.encode()) % 97 for t in TEXTS for g in grams(t)[1])


def test_equal_hashes_are_told_apart_by_bytes():
    words = ngrams.words_of(pa.array(["aa bb aa cc bb " + "q" * 300 + " " + "r" * 300 + " " + "q" * 300]))
    at, length = words.starts, words.ends - words.starts
    table = ngrams.intern(words.data, at, length, 1000, np.zeros(len(at), np.uint64))
    names = [words.data[a : a + n].tobytes() for a, n in zip(at, length, strict=True)]
    assert len(set(table.slot.tolist())) == len(set(names)) == 5
    assert all((table.slot[i] == table.slot[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(len(names)))


def resampled_plainly(rows, target, percent, min_words):
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(zlib.crc32(g.encode()) % 10_000 for g in grams(text)[1])
    for text in target:
        t.update(zlib.crc32(g.encode()) % 10_000 for g in grams(text)[1])
    sa, ta = sum(s.values()), sum(t.values())
    out = []
    for d, text, _ in rows:
        words, found = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + 10_000) / ((s[b] + 1) * (ta + 10_000)))) for b in (zlib.crc32(g.encode()) % 10_000 for g in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((len(words) >= min_words, score, d, len(found), weight))
    enough = sorted((r for r in out if r[0]), key=lambda r: (-r[1], r[2] is None, r[2] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return [(d, n, w, sc, drawn.get(id(r))) for r in out for _, sc, d, n, w in [r]]


def by_text(rows):
    return sorted(map(str, rows))


def test_resampling_equals_brute_force(spark):
    _, make = text_maker(5)
    rows = odd_rows() + [(k, make(10 + k % 50), "a") for k in range(20, 120)]
    target = [make(30) for _ in range(5)] + [None]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for extra in (False, True):
        got = importance.resampled(frame(spark, rows, extra).repartition(5), bench).collect()
        assert by_text(tuple(r) for r in got) == by_text(resampled_plainly(rows, target, 25, 20))


def test_resampling_of_nothing_and_towards_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(frame(spark, []), none).collect() == []
    rows = [(k, "w " * 30, "a") for k in range(8)]
    got = importance.resampled(frame(spark, rows), none).collect()
    assert by_text(tuple(r) for r in got) == by_text(resampled_plainly(rows, [], 25, 20))
    assert {r["doc_id"] for r in importance.drawn_documents(frame(spark, rows, True), none).collect()} == {r["doc_id"] for r in got if r["rank"]}


def test_words_like_the_target_weigh_more(spark):
    _, make = text_maker(8)
    near = [(k, "alpha beta gamma delta " * 10, "a") for k in range(2)]
    rows = near + [(k, make(40), "a") for k in range(10, 40)]
    bench = spark.createDataFrame([(1, "gamma delta alpha beta " * 20)], "item_id long, text string")
    got = {r["doc_id"]: r["weight"] for r in importance.resampled(frame(spark, rows), bench).collect()}
    assert min(got[k] for k in range(2)) > max(got[k] for k in range(10, 40))


def shards_plainly(rows, shards):
    items = sorted(((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows))
    total, before, slots, out = sum(i[2] for i in items), 0, Counter(), []
    for null, d, size, crc in items:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((None if null else d, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def test_shards_equal_brute_force(spark):
    _, make = text_maker(6)
    rows = odd_rows() + [(5, "hot", "a")] * 200 + [(k, make(k % 90), "a") for k in range(30, 300)]
    for extra in (False, True):
        got = [tuple(r) for r in sharding.shards_by_bytes(frame(spark, rows, extra).repartition(7), 24).collect()]
        assert by_text(got) == by_text(shards_plainly(rows, 24))
    assert sharding.shards_by_bytes(frame(spark, [])).collect() == []


def test_shards_are_runs_of_near_equal_bytes(spark):
    _, make = text_maker(9)
    rows = [(k, make(1 + k * 7 % 60), "a") for k in range(500)]
    got = sorted(tuple(r) for r in sharding.shards_by_bytes(frame(spark, rows), 8).collect())
    assert [r[3] for r in got] == sorted(r[3] for r in got)
    sums = Counter()
    for _, size, _, shard, _ in got:
        sums[shard] += size
    most = max(r[1] for r in got)
    assert len(sums) == 8 and all(abs(8 * b - sum(sums.values())) <= 8 * most for b in sums.values())


NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def audit_plainly(turns):
    """turns (role, text, doomed, cut) to (cost, audit, lines) by trying all edits from the back."""

    @lru_cache(None)
    def rest(k, state):
        found = []
        if k == len(turns):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, doomed, cut = turns[k]
            c, a, lines = rest(k + 1, state)
            found.append((c + 3, "D" + a, lines))
            if not doomed:
                to = NEXT[state]
                c, a, lines = rest(k + 1, to)
                if role[:1] == to:
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
                found.append((c + 2 + cut, "R" + a, (f"{NAMES[to]}:{text}", *lines)))
                if state == "" and role[:1] == "s":
                    c, a, lines = rest(k + 1, "s")
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
        # Two inserts in a row before the same turn lead back or to where none was needed, but for these.
        to = NEXT[state]
        for more in (1, 2):
            c, a, lines = steps(k, to, more)
            found.append((c + 2, "I" + a, (f"{NAMES[to]}:", *lines)))
        return min(found)

    @lru_cache(None)
    def steps(k, state, more):
        if more == 2:
            to = NEXT[state]
            c, a, lines = steps(k, to, 1)
            return c + 2, "I" + a, (f"{NAMES[to]}:", *lines)
        found = []
        if k == len(turns):
            return (0, "", ()) if state in ("", "a") else (1 << 40, "", ())
        role, text, doomed, cut = turns[k]
        c, a, lines = rest(k + 1, state)
        found.append((c + 3, "D" + a, lines))
        if not doomed:
            to = NEXT[state]
            c, a, lines = rest(k + 1, to)
            if role[:1] == to:
                found.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
            found.append((c + 2 + cut, "R" + a, (f"{NAMES[to]}:{text}", *lines)))
        return min(found)

    return rest(0, "")


def random_turns(rnd, n):
    return [(rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", " "]), f"t{k}", rnd.random() < 0.2, rnd.random() < 0.3) for k in range(n)]


@pytest.mark.parametrize("mod", [(1 << 61) - 1, 3, 1])
def test_audits_equal_brute_force(mod, monkeypatch):
    """Also with hashes that collide nearly always, or always."""
    monkeypatch.setattr(audit.Audits.__init__, "__defaults__", (mod,))
    rnd = random.Random(mod)
    for n in [*range(9), 30, 200]:
        for _ in range(12):
            turns = tuple(random_turns(rnd, n))
            cost, letters, lines = audit_plainly(turns)
            flags = [(role[:1], doomed, cut) for role, _, doomed, cut in turns]
            assert audit.whole(flags) == (cost, letters)
            assert audit.repaired(letters, audit.START, [(r, t) for r, t, _, _ in turns]) == list(lines)
            # The same in blocks.
            cuts = sorted(rnd.randrange(n + 1) for _ in range(3))
            pieces = [flags[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True) if b > a]
            total, states = audit.choices([audit.block(p) for p in pieces])
            joined = "".join(audit.audit_of(p, states[k], states[k + 1], k + 1 == len(pieces)) for k, p in enumerate(pieces))
            assert (total, joined) == (cost, letters)


def repair_plainly(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = by_conv[conv]
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()))
        seen, faults, flagged = set(), Counter(), []
        for _, role, text in turns:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            flagged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, letters, lines = audit_plainly(tuple(flagged))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(seed):
    rnd = random.Random(seed)
    said = ["Yes.", "No", "Why?", "", " \t", None, "Well. ", "long " * 300 + "."]
    rows = [(conv, rnd.choice([turn, turn, turn + 5, None]), rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(said) if rnd.random() < 0.5 else f"n{turn}.") for conv in [*range(40), None] for turn in range(rnd.randrange(9))]
    rows += [(1000, turn // 2, rnd.choice(["user", "assistant"]), f"{rnd.randrange(400)}.") for turn in range(700)]
    rows += [(1001, 3, "user", "again and again.")] * 300 + [(1001, None, None, None)] * 40
    # A conversation of which the damage leaves nothing.
    gone = next(t for t in range(1000) if not zlib.crc32(f"2000:{t}".encode()) % 20)
    return [*rows, (2000, gone, "user", "gone")]


@pytest.mark.parametrize(("turns", "size"), [(4096, 1 << 20), (7, 1 << 20), (50, 40)])
def test_repair_equals_brute_force(spark, monkeypatch, turns, size):
    monkeypatch.setattr(turn_repair, "BLOCK_TURNS", turns)
    monkeypatch.setattr(turn_repair, "BLOCK_BYTES", size)
    monkeypatch.setattr(turn_repair, "MAX_BROADCAST", 0 if turns == 7 else 100_000)
    rows = conversations(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in turn_repair.repair_report(df.selectExpr("*", "'x' AS name", "1 AS part", "2 AS n", "'k' AS audit").repartition(6)).collect()]
    assert by_text(got) == by_text(repair_plainly(rows))


def test_repair_of_nothing(spark):
    assert turn_repair.repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
