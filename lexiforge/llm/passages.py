"""Passages of WORDS words or more that stand in two places, within or across lines.

The unit is the window of WORDS words over the whole text (A-Z as a-z, white space as one space).
A window's anchor is its MinHash over the 25-word runs in it, one place: equal windows have equal
anchors wherever they stand, so no repeat is missed.  Neighbouring windows with one anchor make a
run of at most STEP windows, named by a hash of its windows.

1. Runs whose anchor comes once cannot repeat and go.  Equal runs are one class, held by its first.
2. Where all runs of an anchor are one class, each window's first place is the class's.  Of anchors
   with several classes the windows of one run a class are compared by their own hashes.
3. Windows that have an earlier place are removed; neighbours with a common source make one span.

Runs and windows count as equal where both their 64-bit hash and their 64-bit anchor, another function of
their words, are the same: 128 bits.  The words themselves are not compared.

Places are ordered by document (those without id last), text hash and word.  Windows that overlap
their own first place in one text (of periodic text) stay.  A row repeated as a whole is one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, keyed_texts, lean, mix, slices, split_words, stage, texts_of

WORDS, HALF = 50, 25
STEP = WORDS - HALF + 1
#: Texts with wanted runs (some 50 bytes a run) up to which the runs are broadcast to the texts.
MAX_BROADCAST = 1_000_000


def _slid(values: np.ndarray, size: int, pair) -> np.ndarray:
    """pair folded over each run of size values, for pairs that may overlap."""
    k = 1
    while 2 * k <= size:
        values = pair(values[:-k], values[k:])
        k *= 2
    return pair(values[: k - size], values[size - k :]) if k < size else values


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x ^ mix(y))


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, hash, anchor) of every window, in order."""
    words, rows = split_words(pc.ascii_lower(texts))
    if len(words) < WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    half = _slid(hashed[coded.indices.to_numpy(zero_copy_only=False)], HALF, _paired)
    anchor = _slid(half, STEP, np.minimum)
    at = np.flatnonzero(rows[: 1 - WORDS] == rows[WORDS - 1 :])
    of = rows[at]
    counts = np.bincount(rows, minlength=len(texts))
    return of, at - (np.cumsum(counts) - counts)[of], _paired(half[at], half[at + HALF]), anchor[at]


def _runs(texts: DataFrame) -> DataFrame:
    """(doc_id, body, word, m, anchor, key) of every run of m windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, word, value, anchor = windows(texts_of(part, "text"))
            if not len(of):
                continue
            fresh = np.ones(len(of), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])
            begin = np.flatnonzero(fresh)
            off = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
            off %= STEP
            begin = np.flatnonzero(off == 0)
            m = np.diff(np.append(begin, len(of)))
            key = mix(np.add.reduceat(mix(value ^ mix(off.astype(np.uint64))), begin) + m.astype(np.uint64)).view(np.int64)
            rows = pa.array(of[begin])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("body").take(rows), pa.array(word[begin], pa.int32()), pa.array(m, pa.int32()), pa.array(anchor[begin].view(np.int64)), pa.array(key)],
                ["doc_id", "body", "word", "m", "anchor", "key"],
            )

    return texts.mapInArrow(lean(run), "doc_id long, body long, word int, m int, anchor long, key long")


def _place(word: str = "word"):
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("body"), F.col(word).alias("word"))


def _window_firsts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Of classes whose anchor has several: (c_key, c_anchor, off, len, f_doc, f_body, f_word), stretches of their windows
    with the places in which these come first."""
    mixed = classes.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = stage(classes.join(mixed, "anchor", "left_semi").select("first", "m", "key", "anchor"), "passage-mixed", 4)
    asked = wanted.groupBy(F.col("first.doc_id").alias("a_doc"), F.col("first.body").alias("a_body")).agg(F.collect_list(F.struct("first.word", "m", "key", "anchor")).alias("asked"))
    asked = stage(asked, "passage-asked", 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, _, value, _ = windows(texts_of(part, "text"))
            begin = np.searchsorted(of, np.arange(part.num_rows))
            lists = part.column("asked")
            flat = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            first, m, key, anchor = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in range(4))
            first, m = first.astype(np.int64), m.astype(np.int64)
            off = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(begin[owner] + first, m) + off
            row = pa.array(np.repeat(owner, m))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(row), part.column("body").take(row), pa.array(np.repeat(first, m) + off, pa.int32()), pa.array(value[at].view(np.int64)), pa.array(np.repeat(key, m)), pa.array(np.repeat(anchor, m)), pa.array(off, pa.int32())],
                ["doc_id", "body", "word", "hash", "key", "anchor", "off"],
            )

    held = texts.join(broadcast_if_small(asked, asked.count(), MAX_BROADCAST), F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("body") == F.col("a_body")))
    found = held.select("doc_id", "body", "text", "asked").mapInArrow(lean(run), "doc_id long, body long, word int, hash long, key long, anchor long, off int")
    # A row repeated as a whole names the same windows again.
    found = stage(found, "passage-windows", 4)
    first = found.groupBy("hash", "anchor").agg(F.min(_place()).alias("w_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash").alias("w_hash"), F.col("anchor").alias("w_anchor"), "w_first")
    met = (F.col("hash") == F.col("w_hash")) & (F.col("anchor") == F.col("w_anchor"))
    late = found.join(first, met, "left").select("key", "anchor", "off", F.coalesce("w_first", _place()).alias("f"))
    # Neighbouring windows with neighbouring places make one stretch; a run has at most STEP of them.
    late = late.select("key", "anchor", "off", F.col("f.doc_id").alias("f_doc"), F.col("f.body").alias("f_body"), (F.col("f.word") - F.col("off")).alias("delta"))
    sets = late.groupBy("key", "anchor", "f_doc", "f_body", "delta").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    islands = F.array_distinct(F.transform("offs", lambda x, k: x - k))
    sets = sets.withColumn("island", F.explode(islands))
    inside = F.filter("offs", lambda x, k: x - k == F.col("island"))
    sets = sets.select("key", "anchor", "f_doc", "f_body", "delta", F.array_min(inside).alias("off"), F.size(inside).alias("len"))
    out = stage(sets.select(F.col("key").alias("c_key"), F.col("anchor").alias("c_anchor"), "off", "len", "f_doc", "f_body", (F.col("delta") + F.col("off")).alias("f_word")), "passage-parts", 4)
    discard(wanted, asked, found)
    return out


def spans(texts: DataFrame) -> DataFrame:
    """texts (doc_id, body, text) to (doc_id, body, word, n_words, f_doc, f_body, f_word), staged: the maximal
    spans that stand in an earlier place, and that place."""
    runs = stage(_runs(texts), "passage-runs")
    often = stage(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "passage-anchors", 4)
    maybe = stage(runs.join(often, "anchor", "left_semi"), "passage-candidates", 2)
    discard(runs, often)
    classes = stage(maybe.groupBy("anchor", "key").agg(F.min(_place()).alias("first"), F.first("m").alias("m"), F.count(F.lit(1)).alias("size")), "passage-classes", 4)
    parts = _window_firsts(texts, classes)
    whole = classes.join(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds = 1").select("anchor"), "anchor", "left_semi").where("size > 1")
    whole = whole.select(F.col("key").alias("c_key"), F.col("anchor").alias("c_anchor"), F.lit(0).alias("off"), F.col("m").alias("len"), F.col("first.doc_id").alias("f_doc"), F.col("first.body").alias("f_body"), F.col("first.word").alias("f_word"))
    stretches = stage(whole.unionByName(parts), "passage-stretches", 4)
    late = maybe.join(stretches, (F.col("key") == F.col("c_key")) & (F.col("anchor") == F.col("c_anchor"))).select("doc_id", "body", (F.col("word") + F.col("off")).alias("word"), "len", "f_doc", "f_body", "f_word")
    apart = ~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("body") == F.col("f_body"))) | (F.col("word") - F.col("f_word") >= WORDS)
    late = late.where(apart).withColumn("shift", F.col("word") - F.col("f_word"))
    # Stretches of one text with one source: where one begins at or before the end of those before, it goes on.
    source = Window.partitionBy("doc_id", "body", "f_doc", "f_body", "shift").orderBy("word")
    reach = F.max(F.col("word") + F.col("len")).over(source.rowsBetween(Window.unboundedPreceding, -1))
    late = late.withColumn("starts", F.coalesce(F.col("word") > reach, F.lit(True)).cast("int"))
    late = late.withColumn("island", F.sum("starts").over(source.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = late.groupBy("doc_id", "body", "f_doc", "f_body", "shift", "island").agg(F.min("word").alias("word"), F.max(F.col("word") + F.col("len")).alias("stop"))
    out = out.select("doc_id", "body", "word", (F.col("stop") - F.col("word") + WORDS - 1).alias("n_words"), "f_doc", "f_body", (F.col("word") - F.col("shift")).alias("f_word"))
    return stage(out, "passage-spans", 4)


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the words of a text begin and end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return point[np.flatnonzero(edge == -1)], point[np.flatnonzero(edge == 1)]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, body (the text's hash), word, n_words, first_doc_id, first_word and removed.
    A removed span names the earlier place of its words; each place that is named has a row too, not
    removed."""
    late = spans(keyed_texts(docs, id_col, text_col))
    gone = late.select("doc_id", "body", "word", "n_words", F.col("f_doc").alias("first_doc_id"), F.col("f_word").alias("first_word"), F.lit(True).alias("removed"))
    source = late.select(F.col("f_doc").alias("doc_id"), F.col("f_body").alias("body"), F.col("f_word").alias("word"), "n_words").distinct()
    source = source.select("doc_id", "body", "word", "n_words", F.col("doc_id").alias("first_doc_id"), F.col("word").alias("first_word"), F.lit(False).alias("removed"))
    return gone.unionByName(source)
