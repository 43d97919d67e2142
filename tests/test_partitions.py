import duckdb
import pytest

from lexiforge import catalog
from lexiforge.functions import partitions
from lexiforge.plans import evaluation

from .conftest import SMALL

NAMES = ["J7_page_range_cover", "J8_target_first_rank", "A6_median_rank", "A7_recall_at_k", "A8_mean_reciprocal_rank", "A9_noise_ratio", "V11_reranker_verdict", "V18_row_builder"]


def rows(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_joins_of_targets_are_dealt_by_rows(spark, monkeypatch, name):
    monkeypatch.setattr(partitions, "TASK_ROWS", 700)
    with duckdb.connect() as db:
        for t in ("orders", "lineitem", "customer"):
            db.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
        want = db.execute(catalog.oracles()[name]).fetchall()
    got = catalog.queries()[name](spark, SMALL)
    assert rows(got.collect()) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(partitions, "TASK_ROWS", 100)
    few, many = spark.range(40), spark.range(900)
    assert partitions.parts_for(few, few) is None and partitions.dealt(few, None, "id") is few
    assert partitions.parts_for(few, many) == 10 and partitions.parts_for(many, many, many) == 27
    # Adaptive execution does not put the partitions of a join together again.
    parts = partitions.parts_for(many, many, many)
    left, right = (partitions.dealt(many, parts, "id") for _ in range(2))
    assert left.join(right, "id").rdd.getNumPartitions() == 27


def test_page_ranges_are_joined_in_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(partitions, "TASK_ROWS", 700)
    n = evaluation.asked(spark, SMALL)[2]
    assert n >= 10
    assert catalog.queries()["J7_page_range_cover"](spark, SMALL).rdd.getNumPartitions() == n
