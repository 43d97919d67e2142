"""The whole retrieval chain against a plain version of each step."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import retrieve as R

CHUNKS = "chunk_id long, document_id string, chunk_type string, table_id string, figure_id string, page int, content string, pack int, prev_ids array<long>, next_ids array<long>"


def world(seed):
    rnd = random.Random(seed)
    chunks = {}
    for c in range(80):
        kind = rnd.choice(["prose", "prose", "table_summary", "table_pack", "figure", "formula"])
        chunks[c] = {
            "chunk_id": c, "document_id": f"d{c % 5}", "chunk_type": kind, "table_id": f"t{c % 6}" if "table" in kind else None, "figure_id": f"f{c % 4}" if kind == "figure" else None, "page": c % 3,
            "content": rnd.choice([f"alpha beta {c} " * rnd.randrange(1, 60), f"gamma {c}", "", None]), "pack": rnd.randrange(1, 4) if kind == "table_pack" else None,
            "prev_ids": rnd.choice([None, [c - 1, c - 2, c - 3]]), "next_ids": [c + 1, c + 200, c + 2],
        }
    requests, channels = [], []
    for r in range(60):
        scope = rnd.choice([None, None, [], ["d1", "d2"], ["d9"]])
        requests.append({"request_id": r, "scope": scope, "allow_tables": rnd.random() < 0.4, "text": "beta gamma 7"})
        low = rnd.choice([0.0, 0.2, 0.6, -0.5])
        for channel in range(rnd.randrange(1, 4)):
            ids = rnd.sample([c for c in chunks if rnd.random() < 0.8 or "table" in chunks[c]["chunk_type"]], 20)
            if r % 7 == 0:
                ids = [c for c in ids if "table" in chunks[c]["chunk_type"]]
            scores = sorted((round(low + rnd.random() * 0.3, 3) for _ in ids), reverse=True)
            channels += [(r, channel, k + 1, c, 0.0 if rnd.random() < 0.1 else s, channel != 1) for k, (c, s) in enumerate(zip(ids, scores, strict=True))]
    return requests, channels, chunks


def words(question, passage):
    asked = set(question.lower().split())
    return round(len(asked & set(passage.lower().split())) / len(asked), 6)


def window_of(primary, before, after, budget):
    text, room = "[primary]\n", max(0, budget - 10)
    if not any([*before, *after]):
        return text + primary[:room] + (f"…[本体省略 {len(primary) - room} 字符]" if len(primary) > room else "")
    n = len(primary) if len(primary) <= max(1, int(budget * 0.6)) else min(len(primary), room)
    text += primary[:n] + (f"…[本体省略 {len(primary) - n} 字符]" if len(primary) > n else "")
    for k in range(2):
        for kind, parts in (("prev", before), ("next", after)):
            if k < len(parts) and parts[k]:
                head = f"[context:{kind} #{k + 1}]\n"
                left = budget - 2 - len(head) - len(text)
                if left < 120:
                    text += f"\n\n…[邻居省略 {len(parts[k])} 字符]"
                else:
                    text += "\n\n" + head + parts[k][:left] + (f"…[邻居省略 {len(parts[k]) - left} 字符]" if len(parts[k]) > left else "")
    return text[:budget]


def plainly(request, rows, chunks, s, score_pair):
    scope = request["scope"]
    window = min(max(s.candidate_k, s.final_k) * 4, 200) if scope is not None else max(s.candidate_k, s.final_k)
    by_channel, fused, best, first, own = defaultdict(list), defaultdict(float), {}, {}, {}
    for _, channel, rank, c, score, slot in sorted(rows, key=lambda x: (x[1], x[2])):
        if rank <= window:
            by_channel[channel].append(c)
            own[channel] = slot
            fused[c] += 1 / (60 + rank)
            best[c] = max(best.get(c, -9), score)
            first.setdefault(c, (channel, rank))
    order = sorted(fused, key=lambda c: (-round(fused[c], 9), first[c]))
    order = [c for c in order if scope is None or chunks[c]["document_id"] in scope]
    pool = []
    for channel in sorted(by_channel):
        free = [c for c in by_channel[channel] if c in order and c not in pool][: s.quota if own[channel] else 0]
        pool += free[: s.candidate_k - len(pool)]
    pool = (pool + [c for c in order if c not in pool])[: max(s.candidate_k, s.final_k)]
    ranked = list(pool)
    if score_pair:
        text = lambda c: (chunks[c]["content"] or "").strip()
        ranked = sorted([c for c in pool if text(c)], key=lambda c: -score_pair(request["text"], chunks[c]["content"])) + [c for c in pool if not text(c)]
    dense = {c: best[c] or -1.0 for c in pool}
    if pool and s.floor_ratio > 0 and max(dense.values()) > 0:
        ranked = [c for c in ranked if dense[c] >= s.floor_ratio * max(dense.values())]
    is_table = lambda c: chunks[c]["chunk_type"].startswith("table")

    def slot(c):
        m = chunks[c]
        return ("t", m["table_id"]) if m["table_id"] else ("f", m["figure_id"]) if m["figure_id"] else ("m", m["document_id"], m["page"]) if m["chunk_type"] == "formula" else ("c", c)

    def collapse(allow):
        kept = []
        for c in ranked:
            if len(kept) >= s.final_k:
                break
            if is_table(c) and not allow:
                continue
            same = [k for k, x in enumerate(kept) if slot(x) == slot(c)]
            if not same:
                kept.append(c)
            elif chunks[c]["chunk_type"] == "table_pack" and chunks[kept[same[0]]]["chunk_type"] == "table_summary":
                kept[same[0]] = c
        return kept

    kept = collapse(request["allow_tables"])
    reopened = not kept and bool(pool)
    allow = request["allow_tables"] or reopened
    kept = collapse(True) if reopened else kept
    top = next(iter(sorted([c for c in pool if allow or not is_table(c)], key=lambda c: -dense[c])), None)
    insured = top is not None and top not in kept
    kept = ([top, *kept] if insured else kept)[: s.final_k]
    low = False
    if s.minimum > 0 and kept:
        enough = [c for c in kept if best[c] >= s.minimum]
        if not enough and s.floor_ratio > 0:
            cut = round(s.floor_ratio * max(best[c] for c in kept), 4)
            low, enough = bool(cut), [c for c in kept if best[c] >= cut]
        elif not enough:
            enough = []
        front = insured and kept[0] in enough and enough[0] == kept[0]
        kept = enough
    else:
        front = insured
    out, seen = [], set()
    for k, c in enumerate(kept):
        m = chunks[c]
        shown, before, after = None, [], []
        if is_table(c) or m["chunk_type"] == "figure":
            again = m["table_id"] in seen
            if not (m["table_id"] and again):
                before = [i for i in (m["prev_ids"] or [])[:2] if i in chunks]
                after = [i for i in (m["next_ids"] or [])[:2] if i in chunks]
            primary = m["content"] or ""
            if m["table_id"]:
                seen.add(m["table_id"])
                shards = sorted((x for x in chunks.values() if x["table_id"] == m["table_id"] and x["content"]), key=lambda x: (x["pack"] or -1, x["chunk_id"]))
                parts = list(dict.fromkeys(x["content"] for x in shards))
                primary = "\n\n".join(parts + ([primary] if primary and primary not in parts else [])) if parts else primary
            text = lambda ids: [chunks[i]["content"] or "" for i in ids]
            shown = window_of(primary, text(before), text(after), s.table_budget if m["table_id"] else s.budget)
        out.append((request["request_id"], k + 1, c, round(best[c], 6), reopened, front and k == 0, low, before, after, shown))
    return out


@pytest.mark.parametrize("case", ["plain", "reranked", "failing", "no floor", "no minimum"])
def test_the_chain_equals_its_steps(spark, case):
    requests, channels, chunks = world(len(case))
    s = {"no floor": R.Settings(floor_ratio=0.0, budget=300, table_budget=900), "no minimum": R.Settings(minimum=0.0, final_k=4, candidate_k=9, quota=2)}.get(case, R.Settings(candidate_k=8, budget=350, table_budget=700, floor_ratio=0.6))
    predict = {"reranked": lambda pairs: [words(q, p) for q, p in pairs], "failing": lambda pairs: [1 / 0 for _ in pairs]}.get(case)
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = R.retrieve(
        of(requests, "request_id long, scope array<string>, allow_tables boolean, text string").repartition(3),
        of(channels, "request_id long, channel int, rank int, chunk_id long, score double, own_slot boolean").repartition(3),
        of(list(chunks.values()), CHUNKS).repartition(3), s, predict,
    ).collect()
    got = sorted((r["request_id"], r["position"], r["chunk_id"], round(r["score"], 6), r["reopened"], r["insured"], r["low_confidence"], r["prev_ids"], r["next_ids"], r["window"]) for r in got)
    want = sorted(row for q in requests for row in plainly(q, [c for c in channels if c[0] == q["request_id"]], chunks, s, words if case == "reranked" else None))
    assert [g[:9] for g in got] == [w[:9] for w in want]
    assert got == want
    assert {r[0] for r in got}.isdisjoint({q["request_id"] for q in requests if q["scope"] in ([], ["d9"])})
    if case == "plain":
        assert any(r[4] for r in got) and any(r[6] for r in got) and any(r[9] for r in got)
    if case == "reranked":
        assert any(r[5] for r in got)


def test_only_eligible_chunks_stay(spark):
    requests, channels, chunks = world(1)
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    eligible = of([(c,) for c in range(0, 80, 3)], "chunk_id long")
    pool = R.pooled(
        of(requests, "request_id long, scope array<string>, allow_tables boolean, text string"), of(channels, "request_id long, channel int, rank int, chunk_id long, score double, own_slot boolean"),
        of(list(chunks.values()), CHUNKS), eligible=eligible,
    )
    assert pool.where(F.col("chunk_id") % 3 != 0).isEmpty() and not pool.isEmpty()
