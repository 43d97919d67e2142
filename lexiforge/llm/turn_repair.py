"""Repair of conversations: faults of turns, and the cheapest edits into a legal order of roles.

Turns are ordered by number (null first) and turns of one number by the MD5 of their role and text.  A
turn is blank (no character but white space), else a duplicate (an earlier turn of the conversation has
its role and text), else truncated (its last character that is no white space is not . ! or ?).  The
edits, their costs and the grammar are in audit.py.

Turns are range-partitioned by conversation and order.  A conversation that lies inside one partition and
is of moderate length is repaired there.  Others, also one that holds a third of all turns, go out in
blocks; a block's costs and ranks (16 numbers each) meet those of the conversation's other blocks, which
fixes the states between them, and then the blocks are repaired apart.  Only the hash of the repaired text
needs a conversation's blocks in sequence: they are streamed through one task, one block at a time.
Turns with one number, role and text are collapsed to a count beforehand, so that not even
they meet in one place.

Nulls: a null role, text or, in the key of the damage, id or number is one space; a null id is a conversation
of its own; a null number comes first and is left out of the gaps.  Equal turns are duplicates after
the first.  A conversation without turns after damage has zeros, an empty audit and the hash of the empty
text.  Long texts are taken whole.  Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import START, Block, audit_of, block, choices, repaired, whole
from .checksums import crc32_sql
from .common import broadcast_if_small, lean, stage

#: Turns and bytes of text up to which a block is one piece.
BLOCK_TURNS, BLOCK_BYTES = 4096, 1 << 20
#: Repeated role and text pairs (about 60 bytes each), and blocks of cut conversations, up to which they are broadcast.
MAX_BROADCAST = 100_000
_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the turns after the damage that a checksum of their key names."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return d.where("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("n"))


def _name(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, n) with name and, where an earlier turn has their role and
    text, later; range-partitioned and sorted, equal ones as one row with their number n."""
    named = turns.withColumn("name", _name(F.col("role"), F.col("text")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = named.groupBy(F.col("conv_id").alias("a_conv"), F.col("name").alias("a_name")).agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
    again = stage(again.where("c > 1").select("a_conv", "a_name", "first"), "repeated-turns", 16)
    few = broadcast_if_small(again, again.count(), MAX_BROADCAST)
    met = F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("name") == F.col("a_name"))
    columns = ("conv_id", "turn", "role", "text", "name")
    once = named.join(few, met, "left_anti").select(*columns, "n", F.lit(False).alias("later"))
    more = named.join(few, met).groupBy(*columns, (place > F.col("first")).alias("later")).agg(F.sum("n").alias("n"))
    by = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("name"))
    return once.unionByName(more).repartitionByRange(*by).sortWithinPartitions(*by)


_PACKED = (
    "conv_id long, done boolean, part int, seq int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "first string, last string, costs array<long>, ranks array<int>, initials array<string>, doomed array<boolean>, cut array<boolean>, "
    "roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"
)


class _Piece:
    """Turns of one conversation in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.texts: list[tuple[str | None, str | None]] = []
        self.size = 0
        self.sums = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        doomed = fault in ("blank", "duplicate")
        if fault:
            self.sums[fault] += 1
        if self.rows and self.rows[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        if turn is not None and turn != self.high:
            self.sums["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append((role[:1], doomed, fault == "truncated"))
        self.texts.append((None, None) if doomed else (role, text))
        self.size += 0 if doomed else len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_TURNS or self.size >= BLOCK_BYTES

    def result(self) -> dict:
        cost, audit = whole(self.rows)
        lines = repaired(audit, START, self.texts)
        return {**self.sums, "low": self.low, "high": self.high, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def block(self) -> dict:
        b = block(self.rows)
        initials, doomed, cut = map(list, zip(*self.rows, strict=True))
        roles, texts = map(list, zip(*self.texts, strict=True))
        ends = {"low": self.low, "high": self.high, "first": initials[0], "last": initials[-1]}
        return {**self.sums, **ends, "costs": b.costs, "ranks": b.ranks, "initials": initials, "doomed": doomed, "cut": cut, "roles": roles, "texts": texts}


def _fault(text: str, later: bool, k: int) -> str:
    trimmed = text.rstrip(_SPACE)
    if not trimmed:
        return "blank"
    return "duplicate" if later or k else "" if trimmed[-1] in ".!?" else "truncated"


def _packer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        piece, now, seq, is_first = _Piece(), None, 0, True

        def out(row: dict) -> None:
            held.append({f.name: row.get(f.name) for f in schema})

        def written() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)
                held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, turn, role, text, _, n, later = row
                if piece.rows and conv != now:
                    # The partition's first conversation may have begun in an earlier one.
                    ended = {"conv_id": now, "done": True, **piece.result()} if not is_first and not seq else {"conv_id": now, "done": False, "part": part, "seq": seq, **piece.block()}
                    out(ended)
                    piece, seq, is_first = _Piece(), 0, False
                elif conv != now and seq:
                    seq, is_first = 0, False
                now = conv
                for k in range(n):
                    piece.add(turn, role, text, _fault(text, later, k))
                    if piece.full():
                        out({"conv_id": now, "done": False, "part": part, "seq": seq, **piece.block()})
                        piece, seq = _Piece(), seq + 1
                        yield from written()
            if len(held) > 1000:
                yield from written()
        if piece.rows:
            out({"conv_id": now, "done": False, "part": part, "seq": seq, **piece.block()})
        yield from written()

    return run


_JOINED = "conv_id long, part int, seq int, begin int, end int, is_last boolean, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"


def _join_blocks(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        """What the blocks of one conversation must know of each other: some hundred bytes a block."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        cost, states = choices([Block(r["costs"], r["ranks"]) for r in rows])
        total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        high = None
        for k, r in enumerate(rows):
            if k and rows[k - 1]["last"] + r["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            if r["low"] is not None:
                total["turns"] -= r["low"] == high
                high = r["high"]
        lows = [r["low"] for r in rows if r["low"] is not None]
        gaps = high - lows[0] + 1 - total["turns"] if lows else 0
        out = []
        for k, r in enumerate(rows):
            mine = {c: total[c] if not k else 0 for c in ("blank", "duplicate", "truncated", "illegal")}
            out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "begin": states[k], "end": states[k + 1], "is_last": k + 1 == len(rows), **mine, "gaps": 0 if k else gaps, "cost": 0 if k else cost})
        return pa.Table.from_pylist(out, schema)

    return run


_TEXT = "conv_id long, part int, seq int, audit string, lines string"


def _edit_block(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                audit = audit_of(list(zip(r["initials"], r["doomed"], r["cut"], strict=True)), r["begin"], r["end"], r["is_last"])
                lines = repaired(audit, r["begin"], zip(r["roles"], r["texts"], strict=True))
                # Null lines: the block leaves none, which is not the same as one empty line.
                row = {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "audit": audit, "lines": "\n".join(lines) if lines else None}
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


_HASHED = "conv_id long, audit string, repaired_sha256 string"


def _stream(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audits, any_line, begun = None, hashlib.sha256(), [], False, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": now, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            for conv, audit, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines")), strict=True):
                if begun and conv != now:
                    yield made()
                    digest, audits, any_line = hashlib.sha256(), [], False
                now, begun = conv, True
                audits.append(audit)
                if lines is not None:
                    digest.update(("\n" if any_line else "").encode() + lines.encode())
                    any_line = True
        if begun:
            yield made()

    return run


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, n) to one row a conversation: its faults, cost, audit and the
    hash of its repaired text."""
    packed = ordered_turns(turns).mapInArrow(lean(_packer(_arrow_schema(_PACKED))), _PACKED)
    packed = stage(packed, "turn-blocks")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    done = packed.where("done").withColumn("gaps", gaps.cast("long")).select("conv_id", *_RESULT)
    blocks = packed.where("not done")
    summary = blocks.select("conv_id", "part", "seq", *_COUNTS, "low", "high", "first", "last", "costs", "ranks")
    joined = stage(summary.groupBy("conv_id").applyInArrow(_join_blocks(_arrow_schema(_JOINED)), _JOINED), "joined-blocks", 16)
    states = joined.select(F.col("conv_id").alias("j_conv"), F.col("part").alias("j_part"), F.col("seq").alias("j_seq"), "begin", "end", "is_last")
    met = F.col("conv_id").eqNullSafe(F.col("j_conv")) & (F.col("part") == F.col("j_part")) & (F.col("seq") == F.col("j_seq"))
    body = blocks.select("conv_id", "part", "seq", "initials", "doomed", "cut", "roles", "texts").join(broadcast_if_small(states, joined.count(), MAX_BROADCAST), met)
    edited = body.drop("j_conv", "j_part", "j_seq").mapInArrow(lean(_edit_block(_arrow_schema(_TEXT))), _TEXT)
    hashed = edited.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(lean(_stream(_arrow_schema(_HASHED))), _HASHED)
    sums = joined.groupBy(F.col("conv_id").alias("s_conv")).agg(*(F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")))
    cut = hashed.join(sums, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select("conv_id", *_RESULT)
    return done.unionByName(cut)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows, whose turns are damaged first."""
    every = rows.select(F.col("conv_id").cast("long").alias("o_conv")).distinct()
    found = repaired_turns(damaged(rows))
    out = every.join(found, F.col("o_conv").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256().hexdigest()
    rest = {"audit": "", "repaired_sha256": empty}
    return out.select(F.col("o_conv").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(rest.get(c, 0))).alias(c) for c in _RESULT))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _ways_sql() -> str:
    """Every way to take one turn: from a state, over inserts, by an edit to a state.  Fixed values of the
    grammar: states 0 start, 1 after system, 2 after user, 3 after assistant."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    rows = []
    for begin in range(4):
        for inserts in range(3):
            at, made = begin, []
            for _ in range(inserts):
                at = after[at]
                made.append("user:" if at == 2 else "assistant:")
            lines = "[" + ",".join(f"'{m}'" for m in made) + "]::VARCHAR[]"
            prefix = "I" * inserts
            rows.append((begin, at, f"{prefix}D", 2 * inserts + 3, lines, "''", "D"))
            to = after[at]
            wanted, name = ("u", "user") if to == 2 else ("a", "assistant")
            rows.append((begin, to, f"{prefix}K", 2 * inserts, lines, f"'{wanted}'", "K"))
            rows.append((begin, to, f"{prefix}R", 2 * inserts + 2, lines, f"'{name}'", "R"))
            if at == 0:
                rows.append((begin, 1, f"{prefix}K", 2 * inserts, lines, "'s'", "K"))
    return ", ".join(f"({a}, {b}, '{letters}', {cost}, {lines}, {want}, '{edit}')" for a, b, letters, cost, lines, want, edit in rows)


ORACLE = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE d <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text), copy) AS k FROM m),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS later,
             lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS prev, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM r),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN later THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
way(a, b, letters, price, lines, want, edit) AS (VALUES {_ways_sql()}),
best AS (SELECT conv_id, 0::BIGINT AS k, 0 AS state, {{'cost': 0, 'audit': '', 'out': []::VARCHAR[]}} AS s FROM (SELECT DISTINCT conv_id FROM o)
         UNION ALL
         SELECT conv_id, k, state, min(s) FROM (
             SELECT f.conv_id, f.k, way.b AS state,
                    {{'cost': best.s.cost + price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, 'audit': best.s.audit || letters,
                      'out': list_concat(best.s.out, lines, CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [want || ':' || text] END)}} AS s
             FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.k = best.k + 1 JOIN way ON way.a = best.state
             WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR left(role, 1) = want)))
         GROUP BY conv_id, k, state),
n AS (SELECT conv_id, count(*) AS k FROM f GROUP BY conv_id),
done AS (SELECT best.conv_id, min({{'cost': s.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
                'audit': s.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                'out': list_concat(s.out, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END)}}) AS s
         FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id WHERE best.k = coalesce(n.k, 0) GROUP BY best.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
             count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE prev IS NOT NULL AND left(prev, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, s.cost::BIGINT AS cost, s.audit AS audit, sha256(array_to_string(s.out, chr(10))) AS repaired_sha256
FROM done LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM done.conv_id
"""
