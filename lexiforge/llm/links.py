"""Similarity links between shingle sets: banding, verification and components.

The input is one row per distinct set: node (long), n (its size), fp (a byte per signature place)
and bands (a hash per band).  Two sets with a Jaccard index of at least num / den collide in some
band but for a chance that the callers state.  The sets of a bucket are then linked so that every
pair that is not connected already has been compared:

1. star: each member with the bucket's least node; verified links give components;
2. more stars, for buckets that still hold several components: members outside the main component
   with a few random nodes inside and outside of it.  A group of near copies is joined by these in a
   number of pairs that is linear in its size;
3. rest: what is left is indexed by rare shingles.  Of two sets that reach the threshold, each has a
   common shingle among its (1 - num / den) * n + 1 rarest, so only members of buckets that share one
   of those can be links.  They are dealt into blocks of about BLOCK, and blocks that meet form one
   tile.  A task takes one tile, compares what belongs to different components, on fingerprints
   first and then on the full sets, and returns the links that connect components: fewer than it has
   rows.

So no pair is written out before it is known to be a link, no task takes a whole bucket, and the
pairs of a large bucket are compared only where they share a rare shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, stage, trim_memory
from .components import components
from .minhash import common_shingles, set_numbers

#: Nodes and shingles to a block, about; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 384, 500_000
#: Random nodes of the main component and outside of it in a round of stars, and the rounds at most.
INSIDE, OUTSIDE, ROUNDS = 4, 2, 4


def least_matches(places: int, num: int, den: int, sigmas: float = 5.3) -> int:
    """Matching places that a pair at the threshold reaches but for a chance of about 1e-7."""
    p = num / den
    return max(0, int(places * p - sigmas * (places * p * (1 - p)) ** 0.5))


def _prefiltered(pairs: DataFrame, nodes: DataFrame, num: int, den: int, places: int) -> DataFrame:
    """Pairs (a, b) whose sizes and fingerprints allow the threshold."""
    need = least_matches(places, num, den)
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("fp").alias(f"fp_{k}"))
    wide = pairs.join(side("b"), "b").join(side("a"), "a")
    wide = wide.where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}").select("a", "b", "fp_a", "fp_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(v.as_buffer() for v in batch.column(c)), np.uint8).reshape(-1, places) for c in ("fp_a", "fp_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= need))

    return wide.mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, places: int) -> DataFrame:
    """The pairs (a, b) with den * |A and B| >= num * |A or B| on the full sets."""
    maybe = stage(_prefiltered(pairs, nodes, num, den, places), "maybe", 16)
    wanted = maybe.select(F.col("a").alias("node")).unionByName(maybe.select(F.col("b").alias("node"))).distinct()
    sets = stage(sets_of(wanted), "sets", 4)
    wide = maybe.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_raw, last = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                raw = batch.column("set_a")[k].as_py()
                if raw != last_raw:  # rows come sorted by a
                    last_raw, last = raw, set_numbers(raw)
                y = set_numbers(batch.column("set_b")[k].as_py())
                both = common_shingles(last, y)
                keep[k] = den * both >= num * (len(last) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return wide.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def _joined(find: dict[int, int], x: int) -> int:
    while find.setdefault(x, x) != x:
        find[x] = find[find[x]]
        x = find[x]
    return x


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """|A and B| of all pairs of sets, by one product over the shingles that two sets or more have."""
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(every)) > 1
    place = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = often[code]
    owner, column = owner[keep], place[code[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for low in range(0, int(often.sum()), width):
        s, e = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[s:e], column[s:e] - low] = 1
        total += has @ has.T
    return total.astype(np.int64)


def tile_links(node: np.ndarray, label: np.ndarray, n: np.ndarray, fp: np.ndarray, raw: list[bytes], low: np.ndarray, num: int, den: int, need: int) -> list[tuple[int, int]]:
    """Links between the rows of a tile that connect its components.  low: the row is of the first
    block; with two blocks only pairs across them count."""
    left, right = np.flatnonzero(low), np.flatnonzero(~low)
    same = not len(right)
    right = left if same else right
    maybe_i, maybe_j = [], []
    for i in left:
        js = right[(label[right] != label[i]) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
        js = js[js > i] if same else js
        if len(js):
            js = js[(fp[js] == fp[i]).sum(axis=1) >= need]
            maybe_i.append(np.full(len(js), i))
            maybe_j.append(js)
    if not maybe_i:
        return []
    i, j = np.concatenate(maybe_i), np.concatenate(maybe_j)
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    at = np.searchsorted(used, np.stack([i, j]))
    sets = [set_numbers(raw[k]) for k in used]
    both = np.array([common_shingles(sets[x], sets[y]) for x, y in at.T]) if len(i) <= 2 * len(used) else _common(sets)[at[0], at[1]]
    good = den * both >= num * (n[i] + n[j] - both)
    links, find = [], {}
    for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
        a, b = _joined(find, int(label[x])), _joined(find, int(label[y]))
        if a != b:
            find[a] = b
            links.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
    return links


def _rare_members(held: DataFrame, num: int, den: int) -> DataFrame:
    """held (node, label, main, n, set) to (key, node, label, main): each node under the shingles of its
    prefix that other nodes have too.  The order of shingles, which all nodes share, is by how many
    have them; those that one node has come first and can't be shared, so they need no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a set a time, whatever its size
                items = set_numbers(batch.column("set")[k].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), batch.column("node")[k].as_py(), np.int64)), pa.array(items)], ["node", "item"])

    items = held.select("node", "set").mapInArrow(lean(run), "node long, item long")
    often = stage(items.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often", 4)
    w = Window.partitionBy("node")
    shared = items.join(often, "item").join(held.select("node", "n", "label", "main"), "node")
    shared = shared.withColumn("rank", F.row_number().over(w.orderBy("often", "item"))).withColumn("shared", F.count(F.lit(1)).over(w))
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    return shared.where(F.col("rank") <= prefix - (F.col("n") - F.col("shared"))).select(F.col("item").alias("key"), "node", "label", "main")


def _rest_links(held: DataFrame, num: int, den: int, places: int) -> DataFrame:
    """held (node, label, main, n, fp, set) of unsettled buckets to links (a, b)."""
    need = least_matches(places, num, den)
    members = stage(_rare_members(held, num, den), "rare", 4)
    keys = members.groupBy("key").agg(F.min("node").alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "pivot")
    members = stage(members.join(keys, "key"), "rare-members", 4)
    home = members.groupBy("node").agg(F.min("pivot").alias("home"))
    home = stage(home.join(held.select("node", "n", "label", "main"), "node"), "homes", 16)
    counts = home.groupBy("home", "main").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("slots"))
    slot = F.pmod(F.xxhash64("node", "label"), F.col("slots"))
    placed = home.join(counts, ["home", "main"]).select("node", "label", F.xxhash64("home", "main", slot).alias("block"))
    placed = stage(placed, "placed", 16)
    spans = placed.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    met = members.select("key", "node").join(placed.select("node", "block"), "node").select("key", "block").distinct()
    met = stage(met.join(spans, "block"), "met", 16)
    x, y = (met.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "xy")
    tiles = x.join(y, "key").where("block_x <= block_y and not (low_x = high_x and low_y = high_y and low_x = low_y)").select("block_x", "block_y").distinct()
    tiles = stage(tiles, "tiles", 16)
    sides = tiles.select(F.col("block_x").alias("block"), "block_x", "block_y").unionByName(tiles.where("block_x < block_y").select(F.col("block_y").alias("block"), "block_x", "block_y"))
    filled = stage(placed.join(held.select("node", "n", "fp", "set"), "node"), "filled", 4)
    rows = filled.join(sides, "block").select("block_x", "block_y", "block", "node", "label", "n", "fp", "set")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        fp = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(-1, places)
        low = (pdf["block"] == pdf["block_x"]).to_numpy()
        got = tile_links(pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["n"].to_numpy(), fp, pdf["set"].tolist(), low, num, den, need)
        trim_memory()
        return pd.DataFrame(got, columns=["a", "b"]).astype("int64")

    return rows.groupBy("block_x", "block_y").applyInPandas(run, "a long, b long")


def _unsettled(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """rest (key, pivot, node) with label and main, the component being the pivot's; only of buckets that
    hold another component too."""
    own = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = labels.select(F.col("node").alias("pivot"), F.col("label").alias("main_label"))
    rows = own.join(main, "pivot", "left").withColumn("main", F.col("label") == F.coalesce("main_label", "pivot"))
    rows = stage(rows.select("key", "pivot", "node", "label", "main"), "members", 16)
    open_keys = rows.groupBy("key").agg(F.bool_or(~F.col("main")).alias("open")).where("open").select("key")
    return stage(rows.join(open_keys, "key", "left_semi"), "unsettled", 16)


def _more_stars(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members outside the main component of their bucket with random nodes."""
    pick = lambda side, k: F.min(F.when(side, F.struct(F.xxhash64("node", F.lit(turn * 31 + k)).alias("h"), "node", "label")))
    picks = [pick(F.col("main"), k) for k in range(INSIDE)] + [pick(~F.col("main"), INSIDE + k) for k in range(OUTSIDE)]
    chosen = rest.groupBy("key").agg(F.array_compact(F.array(*picks)).alias("picks"))
    pairs = rest.where(~F.col("main")).join(chosen, "key").select("node", "label", F.explode("picks").alias("p")).where("label <> p.label")
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def link(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, places: int) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): verified links (a, b) that connect all linked sets, and (node, label) of every
    node that has one.  nodes: (node, n, fp, bands), staged, one row a node."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Spark may split either side where one key is hot.
    buckets = stage(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets", 4)
    met = stage(keyed.join(buckets, "key").where("node <> pivot").select("key", "pivot", "size", "node"), "met-nodes", 4)
    star = met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    edges = stage(verified(star, nodes, sets_of, num, den, places), "star-links", 16)
    labels = stage(components(edges), "labels", 16)
    rest = _unsettled(met.where("size > 2").select("key", "pivot", "node"), labels)
    discard(buckets, met)
    if rest.isEmpty():
        return edges, labels
    wanted = stage(rest.select("node").distinct(), "rest-nodes", 16)
    held = stage(sets_of(wanted).join(nodes.select("node", "n", "fp"), "node"), "held", 2)
    held_sets = lambda asked: held.join(asked, "node", "left_semi").select("node", "set")
    open_before = None
    for turn in range(ROUNDS):
        count = rest.where(~F.col("main")).count()
        if not count or (open_before is not None and 4 * count > 3 * open_before):
            break
        open_before = count
        more = stage(verified(_more_stars(rest, turn), held, held_sets, num, den, places), "more-links", 16)
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        labels = stage(components(edges), "labels", 16)
        rest = _unsettled(rest.select("key", "pivot", "node"), labels)
    if not rest.isEmpty():
        side = rest.groupBy("node").agg(F.min("label").alias("label"), F.bool_or("main").alias("main"))
        more = stage(_rest_links(stage(held.join(side, "node"), "rest-held", 2), num, den, places), "rest-links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = stage(components(edges), "labels", 16)
    return edges, labels
