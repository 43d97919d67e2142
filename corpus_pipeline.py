"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage works on all documents that its predecessor kept.  It is written as Parquet in the
shared folder and read again, so a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm.common import stage
from lexiforge.llm.exact_dedup import drop_copies
from lexiforge.llm.mixing import repeat_documents
from lexiforge.llm.near_dedup import keep_one_each
from lexiforge.llm.packing import packed
from lexiforge.llm.quality import fit_model, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees are fitted on this run's labels."""
    return keep_good(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with five-word shingles and 0.8."""
    return keep_one_each(docs, num=80, den=100, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in the packed sequences."""
    # Workers that also hold other stages' memory remember fewer pieces.
    return packed(docs, max_pieces=150_000)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Boosted trees and MinHash have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
