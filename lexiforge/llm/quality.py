"""Quality rules: a few fixed limits, then gradient-boosted trees over document statistics.

The trees are fitted on the driver on at most ``max_train`` labelled documents (those with the
smallest hash of their id; a documented bound) and flattened into numpy node arrays, which every
task scores in vectorised form.  The score may not rise with the rate of symbols, of repeated
words and of repeated lines (monotonic constraints).  The cut is 0.5, lowered where that is needed
for ``keep_clean`` of the good training documents, scored by trees that have not seen them, to stay.

Nulls: a null text has no words and so fails the limits; a null id has no label; labels that are
null or of unknown documents don't count, and of several labels of one id the least counts.  With
fewer than ``min_train`` labelled documents, or labels of one kind, the fixed limits decide alone.
Empty table: empty result.  Repeated rows are judged alike, each with a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import lean, slices, split_words, texts_of

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that only the trees see.
MORE = ("n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "line_words")
MONOTONE = np.array([-1 if f in ("symbol_rate", "dup_line_rate", "repeat_rate") else 0 for f in FEATURES])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[np.frombuffer(chars, np.uint8)] = 1
    return t


_IS = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_digits": _table(b"0123456789"), "n_marks": _table(b".,;:!?")}


def _byte_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text, how many of its bytes are of each kind (all kinds are ASCII)."""
    raw = texts.buffers()
    at = np.frombuffer(raw[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8)[at[0] : at[-1]] if raw[2] is not None else np.empty(0, np.uint8)
    at = (at - at[0]).astype(np.int64)
    out = {}
    for name, table in _IS.items():
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[name] = total[at[1:]] - total[at[:-1]]
    return out


def _repeat_words(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words that lie in a 3-word window that the text has twice or more."""
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    start = np.flatnonzero(rows[:-2] == rows[2:])
    size = int(codes.max()) + 1
    _, pair = np.unique(codes[:-1].astype(np.int64) * size + codes[1:], return_inverse=True)
    _, triple = np.unique(pair[start].astype(np.int64) * size + codes[start + 2], return_inverse=True)
    _, inverse, count = np.unique(rows[start].astype(np.int64) * (int(triple.max(initial=0)) + 1) + triple, return_inverse=True, return_counts=True)
    hit = start[count[inverse] > 1]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(rows[covered], minlength=n)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS and MORE for each text (an array without nulls)."""
    n = len(texts)
    words, rows = split_words(texts)
    out = _byte_counts(texts)
    out["n_words"] = np.bincount(rows, minlength=n)
    out["n_chars"] = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out["word_chars"] = np.bincount(rows, pc.utf8_length(words).to_numpy(zero_copy_only=False), n).astype(np.int64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_repeat_words"] = _repeat_words(codes, rows, n)
    vocabulary = max(1, len(coded.dictionary))
    out["n_distinct_words"] = np.bincount(np.unique(rows * vocabulary + codes) // vocabulary, minlength=n)
    lists = pc.split_pattern(texts, "\n")
    lines, of = lists.flatten(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.not_equal(pc.ascii_trim_whitespace(lines), "")
    mask = some.to_numpy(zero_copy_only=False)
    line_code = lines.filter(some).dictionary_encode()
    of, size = of[mask], max(1, len(line_code.dictionary))
    distinct = np.unique(of * size + line_code.indices.to_numpy(zero_copy_only=False)) // size
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "n_chars", "n_lines"))
    cols = (np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / words, s["n_distinct_words"] / words, np.log1p(words / lines))
    return np.stack(cols, axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass
class Model:
    """forest: None where there was nothing to fit on; the fixed limits then decide alone."""

    forest: Forest | None
    cut: float

    def judge(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, kept, score)."""
        failed = base_failed(s)
        score = np.ones(len(failed)) if self.forest is None else self.forest.probability(features(s))
        return failed, ~failed & (score >= self.cut), score


_STATS = ", ".join(f"{c} long" for c in COUNTS + MORE)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        s = statistics(texts_of(part, "text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *(pa.array(s[c], pa.int64()) for c in COUNTS + MORE)], ["doc_id", "quality", *COUNTS, *MORE])


def fit_model(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, min_train: int = 60, keep_clean: float = 0.999, junk_out: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most max_train labelled documents.  labels: (doc_id, quality 0/1).

    The cut keeps keep_clean of the good documents that a third of the forest has not seen, but does
    not go so low for it that less than junk_out of the unseen junk goes: a few good labels that are
    wrong don't open the gate.  Of an id with several texts one row of counts, the least, is used."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(lean(_stat_rows), f"doc_id {kind}, quality long, {_STATS}")
    seen = counted.groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS, *MORE)).alias("s")).select("s.*").toPandas()
    # The order in which rows arrive may vary; the fit must not.
    seen = seen.sort_values(list(seen.columns), kind="stable")
    s = {c: seen[c].to_numpy() for c in COUNTS + MORE}
    y = seen["quality"].to_numpy().astype(float)
    fine = ~base_failed(s) if len(y) else np.zeros(0, bool)
    x, y = features(s)[fine] if len(y) else np.zeros((0, len(FEATURES))), y[fine]
    if len(y) < min_train or y.min() == y.max():
        return Model(None, 0.5)
    fold = np.arange(len(y)) % 3
    unseen = np.empty(len(y))
    for k in range(3):
        train = fold != k
        unseen[~train] = fit(x[train], y[train], MONOTONE).probability(x[~train]) if 0 < y[train].mean() < 1 else 1.0
    good = np.sort(unseen[y == 1])
    junk = np.sort(unseen[y == 0])
    lowest = np.nextafter(float(junk[min(len(junk) - 1, int(junk_out * len(junk)))]), 1.0)
    cut = min(0.5, max(lowest, float(good[int((1 - keep_clean) * len(good))])))
    return Model(fit(x, y, MONOTONE), cut)


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, score."""
    schema = "doc_id {}, {}, base_failed boolean, kept boolean, score double".format(docs.schema[id_col].dataType.simpleString(), ", ".join(f"{c} long" for c in COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = statistics(texts_of(part, "text"))
            failed, kept, score = model.judge(s)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model keeps, with their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], text_col):
                _, kept, _ = model.judge(statistics(pa.concat_arrays([pc.fill_null(part.column(at), "")])))
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, model)
