"""Substring deduplication by MinHash banding of paragraphs: near copies of lines, and passages in them.

Two kinds of paragraph are banded, joined, verified and clustered:

1. A line of MIN_WORDS words or more, as the set of its five-word shingles (A-Z as a-z).  Equal sets
   are one class, by a 128-bit digest.  A class's MinHash signature of 24 places makes 12 bands of 2:
   classes with a Jaccard index of 0.8 share a band but for a chance of 5e-6, closer ones more surely
   so.  Colliding classes are verified by the exact Jaccard index of their sets (links.py) and
   clustered by connected components.  Of each cluster the first line stays; the others are removals.
2. A window of 50 words anywhere in the text, across line ends (passages.py).  All windows are
   banded by one MinHash place over their 25-word runs, which equal windows share for certain;
   colliding ones are told apart by 128 bits of hashes, and each class of equal windows is a cluster.
   So a passage that stands inside other text, or is wrapped otherwise, is found whole; one with
   edits only as far as 50 words between them are equal.

MIN_WORDS is what counts as a paragraph: shorter lines (headings, notices) are the matter of line
deduplication.  Within a text of any length nothing else is left out.

Order and ties: places are ordered by document (those without id last), hash of the text, and place.
Nulls: a null text has no paragraphs.  Rows with one id, or none, and different texts are told apart
by their texts.  Repeated rows: a row repeated as a whole is one place, with the same result each time.
Empty table: empty result.  Other columns are not looked at; without_repeats keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, fresh, keyed_texts, lean, ranges, slices, split_words, stage, text_hash, texts_of
from .links import link
from .minhash import band_keys, minhash, packed_sets, prints, set_digests, shingle_sets
from .passages import passages, word_bounds

WIDTH, NUM, DEN = 5, 80, 100
MIN_WORDS = 30
BANDS, ROWS = 12, 2
PLACES = BANDS * ROWS
#: Texts with wanted lines (some 50 bytes a line) up to which the lines are broadcast to the texts.
MAX_BROADCAST_TEXTS = 1_000_000


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, their texts, the first line of each text, words before each line in its text)."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, of = lists.flatten(), np.repeat(np.arange(len(counts)), counts)
    return lines, of, np.cumsum(counts) - counts, counts


def paragraphs(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """texts (doc_id, body, text) to (doc_id, body, paragraph, word, n_words, digest, n, fp, bands) of every
    long enough line.  paragraph counts all lines from 0; word is its first word's number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines, of, first, _ = _lines(texts_of(part, "text"))
            _, rows = split_words(lines)
            words = np.bincount(rows, minlength=len(of))
            before = np.cumsum(words) - words
            long = np.flatnonzero(words >= max(1, min_words))
            if not len(long):
                continue
            values, bounds = shingle_sets(lines.take(pa.array(long)), WIDTH)
            sig = minhash(values, bounds, PLACES)
            keys = (band_keys(sig, BANDS, ROWS).view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            mine = of[long]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(mine)),
                    part.column("body").take(pa.array(mine)),
                    pa.array(long - first[mine], pa.int32()),
                    pa.array(before[long] - before[first[mine]], pa.int32()),
                    pa.array(words[long], pa.int32()),
                    pa.array(set_digests(values, bounds), pa.binary()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([row.tobytes() for row in prints(sig)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                ],
                ["doc_id", "body", "paragraph", "word", "n_words", "digest", "n", "fp", "bands"],
            )

    return texts.mapInArrow(lean(run), "doc_id long, body long, paragraph int, word int, n_words int, digest binary, n long, fp binary, bands array<int>")


def _sets_of(texts: DataFrame, classes: DataFrame):
    """The full sets of wanted nodes, from the lines in which they come first."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                lines, _, first, counts = _lines(texts_of(part, "text"))
                lists = part.column("asked")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(first)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                at = pc.struct_field(flat, "paragraph").to_numpy(zero_copy_only=False).astype(np.int64)
                there = at < counts[owner]
                picked = lines.take(pa.array((first[owner] + at)[there]))
                values, bounds = shingle_sets(picked, WIDTH)
                yield pa.RecordBatch.from_arrays([pc.struct_field(flat, "node").filter(pa.array(there)), packed_sets(values, bounds)], ["node", "set"])

        held = classes.join(wanted, "node", "left_semi").select("node", "first.*")
        asked = held.groupBy(F.col("doc_id").alias("a_doc"), F.col("body").alias("a_body")).agg(F.collect_list(F.struct("paragraph", "node")).alias("asked"))
        asked = stage(asked, "asked", 16)
        asked = broadcast_if_small(asked, asked.count(), MAX_BROADCAST_TEXTS)
        found = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("body") == F.col("a_body"))).select("text", "asked")
        return found.mapInArrow(lean(run), "node long, set binary").dropDuplicates(["node"])

    return sets_of


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line of a cluster of two or more: doc_id, body (the text's hash), paragraph, word,
    n_words, first_doc_id, first_paragraph (the one that stays), cluster_size, removed."""
    texts = keyed_texts(docs, id_col, text_col)
    found = stage(paragraphs(texts, min_words), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body", "paragraph")
    classes = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "paragraph-classes", 4)
    # Of each class its first line makes the node, once even if its row is repeated.
    firsts = found.withColumn("first", place).join(classes.select("digest", "node", F.col("first").alias("c_first")), "digest").where(F.col("first") == F.col("c_first"))
    bands = F.transform("bands", lambda b, k: F.shiftleft(k.cast("long"), 32) + b.cast("long"))
    nodes = firsts.select("node", "n", "fp", bands.alias("bands"))
    # Only a text that is repeated with its id names a class more than once.
    repeats = texts.groupBy("doc_id", "body").count().where("count > 1")
    nodes = stage(nodes if repeats.isEmpty() else nodes.dropDuplicates(["node"]), "paragraph-nodes")
    _, labels = link(nodes, _sets_of(texts, classes), NUM, DEN, PLACES)
    discard(nodes)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    clusters = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("size").alias("cluster_size")).where("cluster_size > 1")
    members = named.select(F.col("digest").alias("m_digest"), "label").join(broadcast_if_small(clusters, clusters.count(), MAX_BROADCAST_TEXTS), "label").drop("label")
    members = stage(members, "paragraph-clusters", 4)
    out = found.select("doc_id", "body", "paragraph", "word", "n_words", "digest").join(members, F.col("digest") == F.col("m_digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body")) & (F.col("paragraph") == F.col("first.paragraph"))
    return out.select("doc_id", "body", "paragraph", "word", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"), "cluster_size", (~stays).alias("removed"))


def all_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of repeated() and of passages(), by kind; a text may have rows of both in one place."""
    lines = repeated(docs, id_col, text_col, min_words).withColumn("kind", F.lit("paragraph"))
    spans = passages(docs, id_col, text_col).withColumn("kind", F.lit("passage"))
    return lines.unionByName(spans, allowMissingColumns=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, removals taken out of their texts: of the words removed, what
    stands from the first to the last of each run of them goes; lines left empty by that go too."""
    gone = all_repeats(docs, id_col, text_col, min_words).where("removed")
    gone = gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("body").alias("g_body")).agg(F.collect_list(F.struct("word", "n_words")).alias("gone"))
    row, key, body, cuts = fresh(docs, "row", "key", "body", "cuts")
    g_doc, g_body = fresh(docs, "g_doc", "g_body")
    gone = gone.select(F.col("g_doc").alias(g_doc), F.col("g_body").alias(g_body), F.col("gone").alias(cuts))
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(body, text_hash(docs, id_col, text_col).cast("long"))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col(g_doc)) & (F.col(body) == F.col(g_body)), "left").drop(key, body, g_doc, g_body)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts, asked = part.column(text_col).to_pylist(), part.column(cuts).to_pylist()
            cut = [t if t is None or not a else _cut(t, np.array([(x["word"], x["n_words"]) for x in a], np.int64)) for t, a in zip(texts, asked, strict=True)]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(cut, part.schema.field(at).type)).select(schema.fieldNames())

    return rows.mapInArrow(lean(run), schema)


def _cut(text: str, spans: np.ndarray) -> str:
    """A text without the words of the spans, and without the lines of which no word is left."""
    begin, end = word_bounds(text)
    lost = np.zeros(len(begin), bool)
    lost[ranges(spans[:, 0], spans[:, 1])] = True
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    newline = codes == 10
    line = np.cumsum(newline) - newline
    edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))).reshape(-1, 2)
    keep = np.ones(len(codes), bool)
    keep[ranges(begin[edges[:, 0]], end[edges[:, 1] - 1] - begin[edges[:, 0]])] = False
    keep |= newline
    of, n = line[begin], int(line[-1]) + 1
    empty = (np.bincount(of[lost], minlength=n) > 0) & (np.bincount(of[~lost], minlength=n) == 0)
    keep &= ~empty[line]
    kept = codes[keep].tobytes().decode("utf-32-le")
    return kept.removesuffix("\n") if empty[-1] else kept


def op3_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    return all_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
