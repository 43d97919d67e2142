"""MinHash near-duplicates: SuperMinHash signatures, banding, verification and components.

Documents with the same shingle set, by a 128-bit digest, are one class.  A class's SuperMinHash signature has 125 places,
in 25 bands of 5 for a threshold of 0.85 and 31 of 4 for 0.8: two classes at the threshold share a
band but for a chance of less than 1e-6, and those more alike more surely so.  links.py compares and verifies the members of each
band on their full sets; a document's component is all it can reach.

Nulls: a null text has an empty set and no links.  A row without id belongs to the component of
its set's class if another row of it has an id, and is then not kept; else its component is null
and it is kept.  An id with several texts has a row for each, linked by its own text; a row repeated
as a whole has the same result each time.  Texts without words are linked with nothing.  Empty
table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, keyed_texts, lean, narrowed, slices, stage, text_hash, texts_of
from .links import link
from .minhash import band_keys, packed_sets, prints, set_digests, shingle_sets, superminhash

PLACES = 125
#: Wanted nodes (16 bytes each) up to which they are broadcast to the texts.
MAX_BROADCAST_NODES = 1_000_000


def layout(num: int, den: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows at which a pair at the threshold is missed with a chance of at
    most ``miss``; the most bands that the places then make."""
    s = num / den
    fits = [r for r in range(1, PLACES + 1) if (1 - s**r) ** (PLACES // r) <= miss]
    if not fits:
        raise ValueError("the threshold is too low for the signature")
    return PLACES // fits[-1], fits[-1]


def features(texts: DataFrame, width: int, bands_of: int, rows_of: int) -> DataFrame:
    """texts (doc_id, body, text) to (doc_id, body, n, digest, fp, bands); bands is empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, bounds = shingle_sets(texts_of(part, "text"), width)
            sig = superminhash(values, bounds, PLACES)
            n = np.diff(bounds)
            keys = band_keys(sig, bands_of, rows_of)
            some = n > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands_of, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            fp = pa.array([row.tobytes() for row in prints(sig)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(n), pa.array(set_digests(values, bounds), pa.binary()), fp, bands], ["doc_id", "body", "n", "digest", "fp", "bands"])

    return texts.mapInArrow(lean(run), "doc_id long, body long, n long, digest binary, fp binary, bands array<long>")


def _judged(docs: DataFrame, num: int, den: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, n, component) of every row; component is null where the class has no id."""
    texts = keyed_texts(docs, id_col, text_col)
    rows = stage(features(texts, width, *layout(num, den)), "features")
    # Of equal sets the row of the least id, and of that id the least text, is the node.
    first = F.min(F.struct("doc_id", "body"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(first.alias("first"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes", 16)
    held = classes.select(F.col("digest").alias("c_digest"), "first", "node")
    picked = rows.join(held, (F.col("digest") == F.col("c_digest")) & (F.col("doc_id") == F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))).select("node", "n", "fp", "bands")
    repeated = picked.groupBy("node").count().where("count > 1")
    nodes = stage(picked if repeated.isEmpty() else picked.dropDuplicates(["node"]), "nodes", 4)

    def sets_of(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                values, bounds = shingle_sets(texts_of(part, "text"), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), packed_sets(values, bounds)], ["node", "set"])

        named = classes.join(wanted, "node", "left_semi").select("node", F.col("first.doc_id").alias("w_doc"), F.col("first.body").alias("w_body"))
        named = stage(named, "wanted", 16)
        named = broadcast_if_small(named, named.count(), MAX_BROADCAST_NODES)
        sets = texts.join(named, (F.col("doc_id") == F.col("w_doc")) & (F.col("body") == F.col("w_body"))).select("node", "text").mapInArrow(lean(run), "node long, set binary")
        return sets if repeated.isEmpty() else sets.dropDuplicates(["node"])

    _, labels = link(nodes, sets_of, num, den, PLACES)
    reached = classes.select("node", "digest", "first.doc_id").join(labels, "node")
    least = stage(reached.groupBy("label").agg(F.min("doc_id").alias("component")), "least", 16)
    joined = reached.join(broadcast_if_small(least, least.count(), MAX_BROADCAST_NODES), "label").select(F.col("node").alias("l_node"), "component")
    named = classes.join(joined, F.col("node") == F.col("l_node"), "left").select(F.col("digest").alias("c_digest"), F.coalesce("component", "first.doc_id").alias("reached"))
    named = stage(named, "named", 4)
    out = rows.select("doc_id", "body", "n", "digest").join(named, (F.col("digest") == F.col("c_digest")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "body", "n", F.when(F.col("n") > 0, F.coalesce("reached", "doc_id")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = _judged(docs, num, den, width, id_col, text_col)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull())
    return narrowed(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """The documents that stay, with their columns: of each component the row of the least id, and of
    several texts with that id the one of the least hash.  Texts without words stay, and so do
    rows whose component has no id."""
    judged = stage(_judged(docs, num, den, width, id_col, text_col).where("n > 0 and component is not null").distinct(), "judged", 4)
    # A component's least id is its name, so only that id's rows compete.
    first = judged.where("doc_id = component").groupBy(F.col("component").alias("f_component")).agg(F.min("body").alias("f_body"))
    lost_doc, lost_body, key, body = fresh(docs, "lost_doc", "lost_body", "key", "body")
    stays = F.coalesce((F.col("doc_id") == F.col("component")) & (F.col("body") == F.col("f_body")), F.lit(False))
    lost = judged.join(first, (F.col("doc_id") == F.col("f_component")) & (F.col("component") == F.col("f_component")), "left").where(~stays)
    lost = lost.select(F.col("doc_id").alias(lost_doc), F.col("body").alias(lost_body)).distinct()
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(body, text_hash(docs, id_col, text_col).cast("long"))
    return rows.join(lost, F.col(key).eqNullSafe(F.col(lost_doc)) & (F.col(body) == F.col(lost_body)), "left_anti").drop(key, body)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
