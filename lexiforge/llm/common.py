"""Helpers that the training-data operators share: staging, batching and word kernels."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: U+0020 and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []
#: Where the DataFrames that stage() returned are written, by their identity.
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local default only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints/lexiforge"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lexiforge-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def narrowed(df: DataFrame, shrink: int = 16) -> DataFrame:
    """df in fewer partitions, for rows of a few ids: a shrink-th of the shuffle partitions, but two
    tasks for each core at least.  Saves tiny files; does not shuffle."""
    spark = df.sparkSession
    few = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shrink)
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, few))


def stage(df: DataFrame, name: str, shrink: int = 1) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, so the
    loss of an executor costs no more than the tasks since this point."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    (narrowed(df, shrink) if shrink > 1 else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*staged: DataFrame) -> None:
    """Deletes what stage() wrote for these, of which all that is made is written by now."""
    for df in staged:
        path = _paths.pop(id(df))
        _staged.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes what stage() wrote; call it once the results that read it are written."""
    _paths.clear()
    while _staged:
        _delete(spark, _staged.pop()[1])


@atexit.register
def _release_at_exit() -> None:
    if _staged:
        try:
            release(_staged[-1][0])
        except Exception:  # the session is gone already
            _staged.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows with one id, or none, apart: a hash of their text; 0 where ids are counted to be
    unique, which spares moving it."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").groupBy("id").count()
    return hashed if not ids.where("count > 1").isEmpty() else F.when(F.col(id_col).cast("long").isNull(), hashed).otherwise(F.lit(0))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, text): null texts as empty, and body by text_hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(docs, id_col, text_col).cast("long").alias("body"), text.alias("text"))


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def trim_memory() -> None:
    """Gives what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, the function of a task, with freed memory given back at its end: Spark keeps the worker for
    later tasks, and its allocators would keep the memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of about max_bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size + 64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column, null as empty, in one contiguous array."""
    return pa.concat_arrays([pc.fill_null(batch.column(column), "")])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the row that each is in."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.not_equal(flat, "")
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        flat, rows = flat.filter(full), rows[mask]
    return flat, rows


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each s, n."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)


_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + _G
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))
