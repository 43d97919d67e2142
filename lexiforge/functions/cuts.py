"""Greedy cuts of a distributed order: each batch takes rows while they fit, and the next begins after it.

Where a batch ends depends on where it began, so the cuts are a chain: a row's successor is the first row
that no longer fits a batch that begins at it.  Successors follow from prefix sums alone.  The order is
divided into blocks of so many rows; a chain enters a block in one of its first ``max_rows`` rows, and for
each of these entries the block says where the chain leaves it, in which row of the next block, and how
many cuts it made.  Composing these steps by pointer doubling finds the entry of every block in
log(blocks) joins of small rows; then each block walks its own chain.  No task sees more than one
block, whatever one key or one length has of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running, written

BLOCK_ROWS = 1 << 16


def successors(starts: np.ndarray, upto: np.ndarray, room: np.ndarray, opens: np.ndarray, max_rows: int) -> np.ndarray:
    """Of each row the first one after it that no longer fits: starts is the sum of costs before a row, upto
    that sum with the row's own cost as last of a batch (ascending), room what a batch may cost, opens
    where a key begins.  What is beyond the rows given is their number."""
    n = len(starts)
    at = np.arange(n)
    full = np.searchsorted(upto, starts + room, "right")
    begins = np.flatnonzero(opens)
    after = np.searchsorted(begins, at, "right")
    following = np.append(begins, n)[after]
    return np.minimum(np.minimum(np.maximum(full, at + 1), at + max_rows), following)


def _columns(table: pa.Table, key: Sequence[str], block: int, size: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(the block's rows and those after it in order, where each stands from the block's first row on,
    whether each opens a key, the mask of the row before the block taken off)."""
    table = table.sort_by("index").combine_chunks()
    index = table.column("index").to_numpy()
    opens = np.zeros(len(index), bool)
    opens[:1] = index[:1] == 0
    for name in key:
        column = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy(zero_copy_only=False)
        opens[1:] |= codes[1:] != codes[:-1]
    keep = index >= block * size
    return table.filter(pa.array(keep)), index[keep] - block * size, opens[keep], keep


def _chain(table: pa.Table, opens: np.ndarray, max_rows: int) -> np.ndarray:
    starts = table.column("before").to_numpy()
    return successors(starts, starts + table.column("_last").to_numpy(), table.column("_room").to_numpy(), opens, max_rows)


def _entries(key: Sequence[str], size: int, max_rows: int):
    def run(group: tuple, table: pa.Table) -> pa.Table:
        block = group[0].as_py()
        rows, at, opens, _ = _columns(table, key, block, size)
        inside = int(np.searchsorted(at, size))
        follow = _chain(rows, opens, max_rows).tolist()
        opened = opens.tolist()
        leave, made, fresh = [0] * inside, [0] * inside, [False] * inside
        for i in range(inside - 1, -1, -1):
            j = follow[i]
            if j >= inside:
                leave[i], made[i], fresh[i] = j - size, 1, opened[i]
            else:
                leave[i], made[i], fresh[i] = leave[j], made[j] if fresh[j] else 1 + made[j], fresh[j] or opened[i]
        n = min(max_rows, inside)
        # A short block is the last one: what follows it is never looked up.
        return pa.table({"b": pa.array([block] * n, pa.int64()), "e": pa.array(range(n), pa.int64()), "nb": pa.array([block + 1] * n, pa.int64()), "ne": pa.array(leave[:n], pa.int64()), "made": pa.array(made[:n], pa.int64()), "opened": pa.array(fresh[:n], pa.bool_())})

    return run


def _walk(key: Sequence[str], size: int, max_rows: int, out: list[str]):
    def run(group: tuple, table: pa.Table) -> pa.Table:
        block = group[0].as_py()
        rows, _, opens, _ = _columns(table, key, block, size)
        n = len(opens)
        entry, number = rows.column("_entry")[0].as_py(), rows.column("_base")[0].as_py() - 1
        follow = _chain(rows, opens, max_rows).tolist()
        cut = np.empty(n, np.int64)
        cut[:entry] = number
        at = entry
        while at < n:
            number = 0 if opens[at] else number + 1
            cut[at : follow[at]] = number
            at = follow[at]
        return rows.select(out).append_column("cut", pa.array(cut))

    return run


def greedy_cuts(
    rows: DataFrame, by: list[Column], cost: Column, budget: Column, max_rows: int, key: Sequence[str] = (),
    last: Column | None = None, block_rows: int = BLOCK_ROWS, stage: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """rows with cut, the number of each row's batch in its key (in the whole order without a key).

    by orders the rows, beginning with the key's columns; cost is what a row takes of the budget, at
    least 0; last, at most the cost, is what it takes as the last row of a batch.  A batch has at most
    max_rows rows and, beyond its first row, no more than the budget.  max_rows must hold for
    every batch, also where only the budget ends them, and be smaller than block_rows."""
    if not 0 < max_rows < block_rows:
        raise ValueError("max_rows must be positive and below block_rows")
    own = list(rows.columns)
    priced = rows.withColumns({"_cost": cost.cast("long"), "_last": (cost if last is None else last).cast("long"), "_room": budget.cast("long")})
    placed = stage(running(priced, by, "_cost", stage), "indexed")
    n = placed.agg(F.max("index")).first()[0]
    if n is None:
        return rows.withColumn("cut", F.lit(0).cast("long"))
    blocks = n // block_rows + 1
    block = F.call_function("div", F.col("index"), F.lit(block_rows)).cast("long")
    within = F.col("index") % block_rows
    # The last row of a block also goes to the next one, which must know whether its key goes on.
    ahead = F.when(within == block_rows - 1, F.array(block, block + 1)).otherwise(F.array(block))
    states = _block_entries(placed, key, block, within, ahead, blocks, block_rows, max_rows, stage)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", cut long"
    spread = placed.withColumn("_block", F.explode(ahead)).where(F.col("_block") < blocks)
    with_entry = spread.join(states, F.col("_block") == F.col("b")).drop("b")
    return with_entry.groupBy("_block").applyInArrow(_walk(key, block_rows, max_rows, own), schema)


def _block_entries(placed, key, block, within, ahead, blocks: int, block_rows: int, max_rows: int, stage) -> DataFrame:
    """(b, _entry, _base): where the chain enters each block, and the batches that its key has by then."""
    spark = placed.sparkSession
    known = spark.createDataFrame([(0, 0, 0)], "b long, _entry long, _base long")
    if blocks == 1:
        return F.broadcast(known)
    # The first rows of a block also go to the one before, whose last batches reach into it.
    both = F.when((within < max_rows) & (block > 0), F.array_union(ahead, F.array(block - 1))).otherwise(ahead)
    spread = placed.select("index", "before", "_last", "_room", *key, F.explode(both).alias("_block")).where(F.col("_block") < blocks)
    jumps = stage(spread.groupBy("_block").applyInArrow(_entries(key, block_rows, max_rows), "b long, e long, nb long, ne long, made long, opened boolean"), "jumps")
    step = 1
    while step < blocks:
        base = F.when(F.col("opened"), F.col("made")).otherwise(F.col("_base") + F.col("made"))
        beyond = known.join(jumps, (known["b"] == jumps["b"]) & (F.col("_entry") == F.col("e"))).where(F.col("nb") < blocks)
        known = stage(known.unionByName(beyond.select(F.col("nb").alias("b"), F.col("ne").alias("_entry"), base.alias("_base"))), "known-blocks")
        step *= 2
        if step < blocks:
            right = jumps.select(F.col("b").alias("rb"), F.col("e").alias("re"), F.col("nb").alias("rnb"), F.col("ne").alias("rne"), F.col("made").alias("rmade"), F.col("opened").alias("ropened"))
            twice = jumps.join(right, (F.col("nb") == F.col("rb")) & (F.col("ne") == F.col("re")))
            made = F.when(F.col("ropened"), F.col("rmade")).otherwise(F.col("made") + F.col("rmade"))
            jumps = stage(twice.select("b", "e", F.col("rnb").alias("nb"), F.col("rne").alias("ne"), made.alias("made"), (F.col("opened") | F.col("ropened")).alias("opened")), "jumps")
    return known
