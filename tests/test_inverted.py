"""The inverted file against the exact search over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import inverted
from lexiforge.operators.vectors import top_k


def unit(spark, x, first=0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(first + k, row.tolist()) for k, row in enumerate(x)], "id long, v array<double>")


def clusters(seed, n, noise):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 16))
    return centres[rnd.integers(0, 12, n)] + noise * rnd.normal(size=(n, 16))


@pytest.mark.parametrize(("noise", "k"), [(0.1, 5), (3.0, 5), (0.1, 300)])
def test_search_equals_the_exact_one(spark, tmp_path, noise, k):
    x = clusters(1, 900, noise)
    x[200:230] = x[200]  # ties
    vectors, queries = unit(spark, x), unit(spark, np.concatenate([x[:900:45], clusters(2, 10, noise)]), 5000)
    index = inverted.build(vectors.repartition(3), 24, f"{tmp_path}/index")
    got, opened = inverted.search(index, queries, k)
    want = sorted(tuple(r) for r in top_k(vectors, queries, k).collect())
    assert sorted(tuple(r) for r in got.collect()) == want
    lists = [r["lists"] for r in opened.collect()]
    full = int((index.width >= 0).sum())
    if noise == 0.1 and k == 5:
        assert len(lists) == 30 and np.mean(lists) < full / 2
    if k == 300:
        assert max(lists) <= full


def test_null_vectors_and_few_vectors(spark, tmp_path):
    vectors = unit(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None)], "id long, v array<double>"))
    index = inverted.build(vectors, 8, f"{tmp_path}/index")
    got, _ = inverted.search(index, vectors.where(F.col("id") != 1), 2)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == [(0, 1, 0, 1.0), (0, 2, 1, 0.0), (2, 1, 2, 1.0), (2, 2, 0, 0.0)]
