"""Connected components of a distributed edge list by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Edges (16 bytes each) that one task takes; beyond, the rounds are distributed.
SMALL = 250_000


def _united(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of all edges at once, for a bounded number of edges."""
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    pairs = pd.concat(parts)
    names, code = np.unique(pairs[["a", "b"]].to_numpy(), return_inverse=True)
    code = code.reshape(-1, 2)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[code[:, 0]], label[code[:, 1]])
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, label[code[:, side]], low)
            np.minimum.at(new, code[:, side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": names, "label": names[label]})


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """edges (a, b) of long to (node, label): label is the least node of the node's component.

    At most ``small`` edges, counted first, are united by one task.  Of more, each round links every node to the least of its neighbours and itself; the neighbours' minima
    are partial aggregates and the joins on a node are ones that Spark can split, so a node with
    many neighbours does not land in one task.  Ends when a round changes nothing."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", 16)
    before = _signature(now)
    if before[0] <= small:
        return now.coalesce(1).mapInPandas(_united, "node long, label long")
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large-star", 16)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = stage(small.where("a <> b").distinct(), "small-star", 16)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
