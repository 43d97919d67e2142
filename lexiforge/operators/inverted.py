"""An inverted file for exact cosine search: vectors by their nearest centroid, lists skipped by a bound.

Centroids are fitted by k-means on a bounded sample.  Every vector is stored under its nearest centroid, and a
list knows the widest angle between its centroid and its vectors.  By the triangle inequality on the
sphere no vector of a list is closer to a query than the angle to the centroid less that width.  A search
first looks into each query's nearest lists; only lists whose bound still reaches the k-th score are read
after that, so the result is the exact one.  Where vectors have no clusters most lists must be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import written
from .vectors import best_of_blocks, in_blocks, matrix_of, ranked

#: Vectors that the centroids are fitted on, and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Lists that every query looks into first.
PROBES = 4
#: More than rounding to the score's digits and doubles can move a score.
SLACK = 2e-6


@dataclass
class Index:
    path: str
    #: Of each list its centroid and the widest angle in it (below 0 for a list without vectors).
    centroids: np.ndarray
    width: np.ndarray


def fitted(vectors: DataFrame, lists: int, seed: int = 1, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length from the ``sample`` vectors of least seeded hash."""
    chosen = vectors.where("v is not null").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = matrix_of(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centroids.T, axis=1)
        for c in range(len(centroids)):
            mine = x[near == c]
            if len(mine) and (norm := np.linalg.norm(total := mine.sum(axis=0))) > 0:
                centroids[c] = total / norm
    return centroids


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def build(vectors: DataFrame, lists: int, path: str, seed: int = 1) -> Index:
    """Stores vectors (id long, v of unit length) by list under path."""
    centroids = fitted(vectors, lists, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(matrix_of(batch.column("v")), centroids)
                near = np.argmin(angle, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(angle[np.arange(len(near)), near]), batch.column("id"), batch.column("v")], ["list", "angle", "id", "v"])

    placed = vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(assign, "list int, angle double, id long, v array<double>")
    placed = written(placed, "assigned")
    width = np.full(len(centroids), -1.0)
    for row in placed.groupBy("list").agg(F.max("angle").alias("w")).collect():  # one row a list
        width[row["list"]] = row["w"]
    # A list may hold a third of all vectors: blocks of it are dealt to several tasks.
    salt = F.pmod(F.xxhash64("id"), F.lit(16))
    in_blocks(placed.repartition("list", salt).sortWithinPartitions("list"), "v", "list").write.partitionBy("list").parquet(path)
    return Index(path, centroids, width)


def _asked(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """(id, v, lists, bounds): of every query the lists in the order of their bounds, the best score that each can hold."""
    centroids, width = index.centroids, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bound = np.cos(np.maximum(0, _angles(matrix_of(batch.column("v")), centroids) - width))
                bound[:, width < 0] = -2
                order = np.argsort(-bound, axis=1, kind="stable")
                rows = [(o[s >= -1].tolist(), s[s >= -1].tolist()) for o, s in zip(order, np.take_along_axis(bound, order, 1), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["id", "v", "lists", "bounds"])

    rows = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, v array<double>, lists array<int>, bounds array<double>")


def _read(spark: SparkSession, index: Index, wanted: DataFrame, k: int, digits: int) -> DataFrame:
    """wanted (list, id, v) against the lists that it names: each block's k best of a query."""
    blocks = in_blocks(wanted.repartition("list").sortWithinPartitions("list"), "q", "list").withColumnRenamed("list", "q_list")
    stored = spark.read.parquet(index.path)
    # Only the named lists' folders are read: the queries' lists prune the partitions.
    return best_of_blocks(stored.join(blocks, F.col("list") == F.col("q_list")), k, digits)


def search(index: Index, queries: DataFrame, k: int, digits: int = 6, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, id, score) as of the exact search, (query_id, lists): how many lists each query read)."""
    spark = queries.sparkSession
    asked = written(_asked(queries, index, probes), "bounds")
    pairs = asked.select("id", "v", F.posexplode(F.arrays_zip("lists", "bounds")).alias("turn", "l")).select("id", "v", "turn", F.col("l.lists").alias("list"), F.col("l.bounds").alias("bound"))
    first = written(ranked(_read(spark, index, pairs.where(F.col("turn") < probes), k, digits), k), "first-found")
    # The k-th score so far; a query with fewer than k has none, so all its lists are read.
    reached = first.groupBy(F.col("query_id").alias("r_id")).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = pairs.where(F.col("turn") >= probes).join(reached, F.col("id") == F.col("r_id"), "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
    rest = written(rest.select("id", "v", "list"), "lists-left")
    more = _read(spark, index, rest, k, digits)
    best = ranked(first.select("query_id", "id", "score").unionByName(more), k)
    opened = pairs.where(F.col("turn") < probes).select("id").unionByName(rest.select("id")).groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("lists"))
    return best, opened
