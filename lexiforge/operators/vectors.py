"""Embedding operators: model-free vectors, validation, normalisation and exact top-k search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.cuts import greedy_cuts

DIMENSIONS = 64
#: Vectors to a block of the search; a task multiplies one block of queries by one of vectors.
BLOCK_ROWS = 4096
#: Queries that meet a block of vectors at once.
SLICE_ROWS = 256
#: Queries (a few hundred bytes each) that are broadcast at once.
MAX_QUERIES = 50_000
FOUND = "query_id long, id long, score double"


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """Unit length; null for a vector that is null, empty, zero or not finite."""
    n = norm(vector)
    good = vector.isNotNull() & (F.size(vector) > 0) & (n > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bow_vectors(texts: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Of each text the counts of its words by CRC-32 bucket, of unit length; zeros for no words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^a-z0-9]+")
    words = lists.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    slot = np.fromiter((zlib.crc32(w.encode()) % dimensions if w else -1 for w in names), np.int64, len(names))
    slot = slot[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
    kept = slot >= 0
    counts = np.bincount(row[kept] * dimensions + slot[kept], minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(float)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, length, out=counts, where=length > 0)


def hashed_bow(text: Column) -> Column:
    """The default embedder, over whole Arrow batches; a real model has the same signature."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(bow_vectors(pa.array(texts, pa.string(), from_pandas=True))), dtype=object)

    return embed(text)


def token_batches(texts: DataFrame, n: str, id_col: str, token_budget: int, batch_size: int) -> DataFrame:
    """Adds batch: texts in the order of their tokens n, then id, at most batch_size and, beyond the
    first of a batch, token_budget tokens together."""
    cut = greedy_cuts(texts, [F.col(n), F.col(id_col)], F.col(n), F.lit(token_budget), batch_size)
    return cut.withColumnRenamed("cut", "batch")


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length, without nulls, as the rows of a matrix."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def in_blocks(df: DataFrame, side: str, key: str | None = None) -> DataFrame:
    """(id long, v array) rows to blocks of ids and one binary matrix, with a key apart for each of its
    values in the order in which they come."""
    keys = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(batch.num_rows)
            cuts = np.flatnonzero(np.diff(value)) + 1
            bounds = np.unique(np.concatenate([[0], cuts, np.arange(0, batch.num_rows, BLOCK_ROWS), [batch.num_rows]])).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(a, b - a)
                columns = [*(part.column(k).slice(0, 1) for k in keys), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix_of(part.column("v")).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, f"{side}_ids", f"{side}_m"])

    schema = "".join(f"{k} int, " for k in keys) + f"{side}_ids array<long>, {side}_m binary"
    return df.where("v is not null").select(*keys, "id", "v").mapInArrow(run, schema)


class Best:
    """The k best vectors so far of each query, a row of the matrix q: by score to so many digits, ties by id."""

    def __init__(self, q: np.ndarray, k: int, digits: int):
        self.q, self.digits = q, digits
        self.scores = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Takes in vectors, the rows of v.  Scores are made for a slice of queries and a block of vectors at a
        time, and only those that may reach a query's k-th place are looked at again."""
        k = self.scores.shape[1]
        for a in range(0, len(v), BLOCK_ROWS):
            block, block_ids = v[a : a + BLOCK_ROWS], ids[a : a + BLOCK_ROWS]
            for s in range(0, len(self.q), SLICE_ROWS):
                score = self.q[s : s + SLICE_ROWS] @ block.T
                cut = self.scores[s : s + SLICE_ROWS, -1]
                if len(block) > k and np.isneginf(cut).any():
                    cut = np.maximum(cut, np.partition(score, len(block) - k, axis=1)[:, len(block) - k])
                # What is less than a rounding step below may tie, so that ids decide.
                row, column = np.nonzero(score >= (cut - 10.0**-self.digits)[:, None])
                if len(row):
                    self._merge(s, row, block_ids[column], np.round(score[row, column], self.digits) + 0.0)

    def _merge(self, s: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, k = np.unique(row), self.scores.shape[1]
        rows = np.concatenate([row, np.repeat(touched, k)])
        scores = np.concatenate([scores, self.scores[s + touched].ravel()])
        ids = np.concatenate([ids, self.ids[s + touched].ravel()])
        order = np.lexsort((ids, -scores, rows))
        first = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(k)]
        self.scores[s + touched], self.ids[s + touched] = scores[first], ids[first]

    def batches(self, q_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.q), BLOCK_ROWS):
            row, column = np.nonzero(self.scores[s : s + BLOCK_ROWS] > -np.inf)
            columns = [q_ids[s + row], self.ids[s + row, column], self.scores[s + row, column]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "id", "score"])


def best_of_blocks(met: DataFrame, k: int, digits: int) -> DataFrame:
    """Blocks of queries beside blocks of vectors (q_ids, q_m, v_ids, v_m) to each pair of blocks' own k best
    of a query: (query_id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, v_ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("q_ids", "v_ids"))
                q, v = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c, n in (("q_m", len(q_ids)), ("v_m", len(v_ids))))
                best = Best(q, k, digits)
                best.add(v_ids, v)
                yield from best.batches(q_ids)

    return met.select("q_ids", "q_m", "v_ids", "v_m").mapInArrow(run, FOUND)


def best_of_partitions(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """vectors (id, v) and queries (id, v), at most MAX_QUERIES, to each partition's own k best vectors of a query.

    The queries are one matrix that all tasks share; a task reads its vectors a batch at a time and keeps
    k of them a query, so its memory does not grow with the vectors."""
    asked = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), "v").toArrow()
    ids = np.concatenate([np.empty(0, np.int64), *(c.to_numpy() for c in asked.column("id").chunks)])
    rows = [matrix_of(c) for c in asked.column("v").chunks if len(c)]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.concatenate(rows) if rows else np.empty((0, 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best = Best(q, k, digits)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("id").to_numpy(), matrix_of(batch.column("v")))
        yield from best.batches(q_ids)

    return vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, FOUND)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) to the k best of each query with their rank, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact cosine search: vectors (id, v) and queries (id, v) of unit length to
    (query_id, rank, id, score), ties by id.

    Each partition of the vectors yields its own k best of every query, which one window per query then
    ranks.  A scope is a filter on ``vectors`` and so reaches its scan.  The queries, which are counted,
    are broadcast up to MAX_QUERIES at once; more of them go in rounds."""
    rounds = -(-queries.count() // MAX_QUERIES)
    parts = [queries] if rounds < 2 else [queries.where(F.pmod(F.xxhash64("id"), F.lit(2 * rounds)) == r) for r in range(2 * rounds)]
    return ranked(reduce(DataFrame.unionByName, (best_of_partitions(vectors, part, k, digits) for part in parts)), k)
