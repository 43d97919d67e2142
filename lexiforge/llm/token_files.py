"""Token ids in compressed binary files: written and read back.

Files hold documents in ascending doc_id order.  A file is a run of records, each a length (unsigned
32 bits, little-endian), that many bytes and a line feed:

  header   b"LXTOK1", CRC-32 of the frequency table, number of the file in the order of ids
  blocks   any number of asymmetric-numeral-system blocks (see ans.py)
  index    b"LXIDX1", number of documents, then their ids (signed 64 bits), whether each id is null
           (one byte) and their counts of tokens (unsigned 32 bits), and a CRC-32 of all that

The frequency table is counted over all tokens and shared by all files.  The files are Spark's own
writer's, so a lost executor's files are written again and no half-written one is seen; readers
take whole files and decode a file's segments side by side.

Nulls: a null text is empty and has just the end id; null ids come before all others.  Rows of the
same id stand next to each other.  Empty table: no files, empty result.  Other columns are not
looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ans import BLOCK, CorruptBlock, Table, decode_blocks, encode_blocks
from .common import slices, stage_path, texts_of
from .tokens import default_path, encoder

MAGIC, INDEX = b"LXTOK1", b"LXIDX1"
#: Tokens to a file, about, and to a record of blocks.
FILE_TOKENS, RUN_TOKENS = 4 << 20, 8 * BLOCK


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids, n): ids as little-endian unsigned integers of the given numpy kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches, "text", 8 << 20):
            ids, bounds = encode.encode(texts_of(part, "text"), end_id)
            size = np.dtype(kind).itemsize
            cut = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), cut, pa.array(np.diff(bounds))], ["doc_id", "ids", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, n long")


def _record(body: bytes) -> bytes:
    return struct.pack("<I", len(body)) + body


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    raw, at = column.buffers(), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw[2], kind, (at[-1] - at[0]) // size, at[0]) if at[-1] > at[0] else np.empty(0, kind)


def count_tokens(tokens: DataFrame, kind: str) -> Table:
    """The shared table; the driver gets one row per distinct id, so at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(_flat(batch.column(0), kind))
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "c"])

    rows = tokens.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    return Table.of_counts(np.array([r["id"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64))


def write_files(tokens: DataFrame, table: Table, out: str, kind: str, file_tokens: int = FILE_TOKENS) -> None:
    """tokens (doc_id, ids, n) to files in ascending doc_id order."""
    total = tokens.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // file_tokens))
    raw_table = table.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(raw_table)
        doc_ids, nulls, counts, waiting, held, begun = [], [], [], [], 0, False

        def put(*bodies: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(map(_record, bodies), pa.binary())], ["record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                begun = True
                yield put(MAGIC + struct.pack("<IQ", zlib.crc32(raw_table), TaskContext.get().partitionId()))
            column = batch.column("doc_id")
            nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            counts.append(batch.column("n").to_numpy(zero_copy_only=False))
            waiting.append(_flat(batch.column("ids"), kind).astype(np.uint32))
            held += len(waiting[-1])
            if held >= RUN_TOKENS:
                ids = np.concatenate(waiting)
                for k in range(0, held - RUN_TOKENS + 1, RUN_TOKENS):
                    yield put(*encode_blocks(ids[k : k + RUN_TOKENS], shared))
                waiting = [ids[held // RUN_TOKENS * RUN_TOKENS :]]
                held = len(waiting[0])
        if begun:
            body = INDEX + struct.pack("<Q", sum(map(len, counts))) + np.concatenate(doc_ids).astype("<i8").tobytes() + np.concatenate(nulls).tobytes() + np.concatenate(counts).astype("<u4").tobytes()
            yield put(*encode_blocks(np.concatenate(waiting), shared), body + struct.pack("<I", zlib.crc32(body)))

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    records = ordered.select("doc_id", "ids", "n").mapInArrow(run, "record binary")
    # A binary value cast to a string keeps its bytes, and the text writer copies them.
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(out)


def parse_file(raw: bytes) -> tuple[int, int, list[bytes], bytes]:
    """(CRC-32 of the table, file number, blocks, index) of one file."""
    records, at = [], 0
    view = memoryview(raw)
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        records.append(bytes(view[at + 4 : at + 4 + size]))
        at += 4 + size + 1
    if at != len(raw) or len(records) < 2 or records[0][:6] != MAGIC or records[-1][:6] != INDEX:
        raise CorruptBlock("not a token file, or cut off")
    crc, number = struct.unpack_from("<IQ", records[0], 6)
    if zlib.crc32(records[-1][:-4]) != struct.unpack("<I", records[-1][-4:])[0]:
        raise CorruptBlock("index")
    return crc, number, records[1:-1], records[-1]


def read_files(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """(file, doc_id, at, n, ids_crc32) of every document; at: the ids of the same file before it."""
    raw_table = table.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(raw_table)
        for batch in batches:
            for content in batch.column(0):
                crc, number, blocks, index = parse_file(content.as_buffer().to_pybytes())
                if crc != zlib.crc32(raw_table):
                    raise CorruptBlock("another frequency table")
                n = struct.unpack_from("<Q", index, 6)[0]
                doc_id = np.frombuffer(index, "<i8", n, 14)
                null = np.frombuffer(index, np.uint8, n, 14 + 8 * n).astype(bool)
                counts = np.frombuffer(index, "<u4", n, 14 + 9 * n).astype(np.int64)
                ids = decode_blocks(blocks, shared).astype("<u4", copy=False)
                ends = np.cumsum(counts)
                if (int(ends[-1]) if n else 0) != len(ids):
                    raise CorruptBlock("index and blocks differ")
                crcs = [zlib.crc32(ids[e - c : e].data) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(doc_id, mask=null), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())], ["file", "doc_id", "at", "n", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(run, "file long, doc_id long, at long, n long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes all documents' ids to files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = tokenizer or default_path()
    kind = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    staged = stage_path(spark, "tokens")
    tokenised(docs, id_col, text_col, path, end_id, kind).write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.parquet(staged)
    table = count_tokens(tokens, kind)
    out = stage_path(spark, "token-files")
    write_files(tokens, table, out, kind)
    back = stage_path(spark, "token-index")
    read_files(spark, out, table).write.parquet(back)
    rows = spark.read.parquet(back)
    # One row per file; a file has some million tokens.
    totals = rows.groupBy("file").agg(F.sum("n").alias("n"))
    before = totals.select(F.col("file").alias("f"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(before, rows["file"] == before["f"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
