"""Greedy batches over a distributed order against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import cuts


def plainly(rows, budget_of, max_rows):
    """rows (key, order, cost, last) to {(key, order): batch}."""
    out, now, first, used, taken, number = {}, object(), 0, 0, 0, -1
    for key, order, cost, last in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if key != now:
            now, number, used, taken = key, -1, 0, 0
        if not taken or taken >= max_rows or used + last > budget_of(key):
            number, used, taken = number + 1, 0, 0
        used, taken = used + cost, taken + 1
        out[key, order] = number
    return out


@pytest.mark.parametrize("block_rows", [1 << 16, 64, 20])
@pytest.mark.parametrize("kind", ["mixed", "one length", "one key"])
def test_cuts_equal_a_plain_loop(spark, block_rows, kind):
    rnd = random.Random(block_rows)
    keys = [7] if kind == "one key" else [None, 1, 2, 3, 4, 5]
    rows = []
    for order in range(900):
        cost = 5 if kind == "one length" else rnd.choice([1, 2, 3, 9, 40])
        rows.append((rnd.choice(keys), order, cost, cost - rnd.randrange(2)))
    if kind == "mixed":
        rows += [(9, k, 1, 1) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, place long, cost long, last long").repartition(5)
    room = lambda key: 17 + (key or 0)
    got = cuts.greedy_cuts(df, [F.col("key").asc_nulls_first(), F.col("place")], F.col("cost"), F.lit(17) + F.coalesce("key", F.lit(0)), 12, ["key"], F.col("last"), block_rows)
    assert {(r["key"], r["place"]): r["cut"] for r in got.collect()} == plainly(rows, room, 12)
    whole = cuts.greedy_cuts(df.select("place", "cost"), [F.col("place")], F.col("cost"), F.lit(30), 15, block_rows=block_rows)
    flat = plainly([(0, o, c, c) for _, o, c, _ in rows], lambda _: 30, 15) if kind != "mixed" else None
    if flat:
        assert {r["place"]: r["cut"] for r in whole.collect()} == {o: n for (_, o), n in flat.items()}


def test_no_rows_and_wrong_bounds(spark):
    none = spark.createDataFrame([], "place long, cost long")
    assert cuts.greedy_cuts(none, [F.col("place")], F.col("cost"), F.lit(3), 4).collect() == []
    with pytest.raises(ValueError, match="max_rows"):
        cuts.greedy_cuts(none, [F.col("place")], F.col("cost"), F.lit(3), 10, block_rows=10)


def test_no_task_has_more_than_a_block(spark):
    """All rows of one length and one key: the largest group is a block with its margins."""
    df = spark.range(2000).select(F.lit(1).alias("key"), F.col("id").alias("place"), F.lit(4).alias("cost"))
    seen = []

    real = cuts._columns

    def counted(table, key, block, size):
        if table.num_rows > size + 8 + 1:
            raise AssertionError("more than a block")
        return real(table, key, block, size)

    cuts._columns = counted
    try:
        got = cuts.greedy_cuts(df, [F.col("key"), F.col("place")], F.col("cost"), F.lit(20), 8, ["key"], block_rows=100).collect()
    finally:
        cuts._columns = real
    assert {r["place"]: r["cut"] for r in got} == {k: k // 5 for k in range(2000)} and not seen


def packed_plainly(table, rows):
    """One table's packs as texts, line by line."""
    caption = table["caption"] if len(table["caption"]) <= 200 else table["caption"][:199] + "…"
    names = "headers: " + " | ".join(table["headers"]) if table["headers"] else ""
    if rows and table["headers"]:
        lines = [" | ".join(f"{table['headers'][i]}: {c}" if i < len(table["headers"]) else str(c) for i, c in enumerate(cells)) for cells in rows]
    elif table["facts"]:
        lines = [" | ".join(p.strip() for p in f.removeprefix("[table-fact]").strip().split("|")[-3:]) for f in table["facts"]]
    else:
        lines = [table["text"] or "table"]

    def text(part):
        body = "\n".join([f"[table] {caption}", names, *part]).strip()
        return f"{table['prefix']}\n{body}" if table["prefix"] else body

    packs, now = [], []
    for line in lines:
        if now and len(text([*now, line])) // 4 > 512:
            packs.append(now)
            now = []
        now = [*now, line]
    return [text(p) for p in [*packs, now]]


def test_tables_are_packed_under_their_own_heads(spark):
    from lexiforge.operators import chunks as C

    rnd = random.Random(4)
    tables, rows = [], {}
    for k in range(30):
        headers = [f"h{i}" for i in range(k % 4)]
        tables.append({"table_id": k, "caption": "c" * (k * 9), "headers": headers, "facts": [f"[table-fact] x | r{i} | h | {i}" for i in range(k % 3 * 90)], "text": None if k % 2 else f"text {k}", "prefix": "" if k % 5 else "p" * 300})
        rows[k] = [[rnd.choice(["", "v ", "w" * rnd.randrange(90), None]) for _ in range(1 + k % 5)] for _ in range(0 if k % 7 == 0 else 4000 if k == 11 else k * 3)]
    rows[13][5] = ["z" * 5000]
    df = spark.createDataFrame(tables, "table_id long, caption string, headers array<string>, facts array<string>, text string, prefix string")
    cells = spark.createDataFrame([(k, i, c) for k, many in rows.items() for i, c in enumerate(many)], "table_id long, row_no long, cells array<string>")
    got = C.tables_packed(df, cells.repartition(4), block_rows=2500).collect()
    for t in tables:
        mine = sorted((r["pack"], r["retrieval_text"], r["over"]) for r in got if r["table_id"] == t["table_id"])
        want = packed_plainly(t, rows[t["table_id"]])
        assert [m[1] for m in mine] == [w if len(w) // 4 <= 512 else w[:2047].rstrip(" ") + "…" for w in want]
        assert [m[2] for m in mine] == [len(w) // 4 > 512 for w in want]
    assert sum(r["over"] for r in got) >= 1
