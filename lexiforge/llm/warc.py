"""WARC files and a Merkle fixity audit of replicas.

Records are hashed in the order of their offsets.  A leaf covers the records that begin in one range
of RANGE bytes; inner nodes cover FAN nodes of the level below, so a tree's shape depends on offsets
alone and a replica that lost or gained records still compares.  Every file has a tree; file roots
are hashed, in the order of files, into the replica's root.  An audit compares the roots and goes
down only where they differ: to files, to their branches, level by level, to ranges, and there to
records, which are then changed, missing in the other replica or extra in it.

Files are Spark's own writer's, in gzip or plain.  A gzip file is packed as a whole, so offsets are those
of the unpacked stream and a record is reached from the file's start.  A file that can't be read counts
as one without records and all its records as missing.  Nulls: a null html is an empty record, a null url an empty
one, a null page_id is kept.  Repeated rows are records of their own.  Empty table: two empty
replicas, empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, stage_path

RANGE, FAN = 1 << 16, 16
FILE_RECORDS = 2048
DATE = "2024-01-01T00:00:00Z"
_NAME = r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record, without the two line ends after it."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%20"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def write(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """One string column of records to WARC files.  The line separator is WARC's record end."""
    records.toDF("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)
_PAGE = re.compile(rb"\r\nWARC-Record-ID: *<urn:page:(-?\d+)>", re.I)


def parse(data: bytes) -> Iterator[tuple[int, int, int | None]]:
    """(offset, length, page id) of each record; damaged parts run to the next record's start."""
    at, size = 0, len(data)
    while at < size:
        stop, page = -1, None
        if _HEAD.match(data, at):
            head = data.find(b"\r\n\r\n", at)
            length = _LENGTH.search(data, at, head + 2) if head >= 0 else None
            named = _PAGE.search(data, at, head + 2) if head >= 0 else None
            page = int(named[1]) if named else None
            if length:
                end = head + 4 + int(length[1])
                if data[end : end + 4] == b"\r\n\r\n":
                    stop = end + 4
        if stop < 0:
            follow = data.find(b"\r\n\r\nWARC/1.", at)
            stop = size if follow < 0 else follow + 4
        yield at, stop - at, page
        at = stop


def _unzipped(raw: bytes) -> bytes | None:
    if raw[:2] != b"\x1f\x8b":
        return raw
    try:
        out = []
        while raw:
            d = zlib.decompressobj(31)
            out.append(d.decompress(raw) + d.flush())
            if not d.eof:
                return None
            raw = d.unused_data
        return b"".join(out)
    except zlib.error:
        return None


def tree(leaves: dict[int, bytes]) -> list[tuple[int, int, bytes]]:
    """(level, index, hash) of all nodes over the leaves; the last one is the root."""
    nodes, level, now = [], 0, leaves
    while True:
        nodes += [(level, k, now[k]) for k in sorted(now)]
        if len(now) <= 1 and (not now or next(iter(now)) == 0):
            return nodes
        above: dict[int, hashlib._Hash] = {}
        for k in sorted(now):
            above.setdefault(k // FAN, hashlib.sha256(b"\x01")).update(k.to_bytes(8, "big") + now[k])
        now, level = {k: h.digest() for k, h in above.items()}, level + 1


_SCHEMA = "file string, level int, at long, length long, page_id long, hash binary"


def fixity(spark: SparkSession, path: str) -> DataFrame:
    """All records (level -1; at: the offset) and tree nodes (level from 0; at: the index) of a
    replica's files.  A file is named by its place among the replica's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = re.search(_NAME, name)
                file = f"{int(found[1]):08d}-{int(found[2] or 0):05d}" if found else name.rpartition("/")[2]
                data = _unzipped(content.as_buffer().to_pybytes()) or b""
                rows, leaves = [], {}
                for at, length, page in parse(data):
                    digest = hashlib.sha256(data[at : at + length]).digest()
                    rows.append((-1, at, length, page, digest))
                    leaf = leaves.setdefault(at // RANGE, hashlib.sha256(b"\x00"))
                    leaf.update(at.to_bytes(8, "big") + length.to_bytes(8, "big") + digest)
                rows += [(level, k, None, None, h) for level, k, h in tree({k: v.digest() for k, v in leaves.items()})]
                level, at, length, page, digest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows)), pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(page, pa.int64()), pa.array(digest, pa.binary())],
                    ["file", "level", "at", "length", "page_id", "hash"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


def file_roots(replica: DataFrame) -> DataFrame:
    """(file, level, hash) of each file's root."""
    top = replica.where("level >= 0").groupBy("file").agg(F.max("level").alias("level"))
    return replica.join(top, ["file", "level"]).select("file", "level", "hash")


def root(replica: DataFrame, fan: int = 256) -> str:
    """The replica's root: file roots hashed in order, ``fan`` at a time, until one is left."""
    rows = file_roots(replica).select("file", F.hex("hash").alias("hash"))
    # Files are ranked by name without a global window: ranks within the partition number's group.
    key = F.substring("file", 1, 8)
    while True:
        rows = rows.groupBy(key.alias("file")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "hash"))), lambda s: F.concat(s["file"], s["hash"])), "|"), 256).alias("hash"))
        rows = stage(rows, "roots")
        n = rows.count()
        if n <= 1:
            return rows.first()["hash"] if n else hashlib.sha256(b"").hexdigest()
        key = F.lpad(F.floor(F.conv(F.col("file"), 10, 10).cast("long") / fan).cast("string"), 8, "0")


def _differ(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    x, y = a.select(*on, F.col("hash").alias("x")), b.select(*on, F.col("hash").alias("y"))
    return x.join(y, on, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*on)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Replicas as of fixity() to (file, offset, page_id, length, status) of the records that differ:
    changed, missing (not in b) or extra (only in b)."""
    if root(a) == root(b):
        return a.where("false").select("file", F.col("at").alias("offset"), "page_id", "length", F.lit("").alias("status"))
    files = _differ(file_roots(a).drop("level"), file_roots(b).drop("level"), ["file"])
    files = stage(files, "differing-files")
    a, b = a.join(files, "file", "left_semi"), b.join(files, "file", "left_semi")
    tops = stage(a.where("level >= 0").unionByName(b.where("level >= 0")).groupBy("file").agg(F.max("level").alias("top")), "tops")
    highest = tops.agg(F.max("top")).first()[0]
    front = stage(tops.where("false").select("file", F.lit(0).cast("long").alias("at")), "front")
    for level in range(highest if highest is not None else -1, -1, -1):
        # Only children of differing nodes, and the roots of files whose tree ends here, are compared.
        below = front.unionByName(tops.where(F.col("top") == level).select("file", F.lit(0).cast("long").alias("at"))).select("file", F.col("at").alias("parent")).distinct()
        at = lambda r, level=level, below=below: r.where(F.col("level") == level).withColumn("parent", F.floor(F.col("at") / FAN)).join(below, ["file", "parent"], "left_semi").select("file", "at", "hash")
        front = stage(_differ(at(a), at(b), ["file", "at"]), f"level-{level}", 16)
    part = lambda r, s: r.where("level = -1").join(front.withColumnRenamed("at", "span"), (r["file"] == front["file"]) & (F.floor(r["at"] / RANGE) == F.col("span")), "left_semi").select("file", F.col("at").alias("offset"), *(F.col(c).alias(f"{c}_{s}") for c in ("page_id", "length", "hash")))
    both = part(a, "a").join(part(b, "b"), ["file", "offset"], "full")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    both = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")) | ~F.col("length_a").eqNullSafe(F.col("length_b")))
    return both.select("file", "offset", F.coalesce("page_id_a", "page_id_b").alias("page_id"), F.coalesce("length_a", "length_b").alias("length"), status.alias("status"))


def damaged(html: Column, page_id: Column) -> Column:
    """The test damage of the query: in one of 97 pages, by hash, the last character is another."""
    hit = F.pmod(F.xxhash64(page_id), F.lit(97)) == 0
    other = F.when(F.right(html, F.lit(1)) == "~", "^").otherwise("~")
    return F.when(hit & (F.length(html) > 0) & F.right(html, F.lit(1)).rlike(r"^[\x20-\x7E]$"), F.concat(F.left(html, F.length(html) - 1), other)).otherwise(html)


def audited_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as two replicas, the second with the test damage, and audits them: one row
    per record of the first replica."""
    spark = pages.sparkSession
    first, second = stage_path(spark, "warc-a"), stage_path(spark, "warc-b")
    write(pages.select(record(F.col("page_id"), F.col("url"), F.col("html"))), first)
    write(pages.select(record(F.col("page_id"), F.col("url"), damaged(F.col("html"), F.col("page_id")))), second)
    a, b = stage(fixity(spark, first), "fixity-a"), stage(fixity(spark, second), "fixity-b")
    found = stage(audit(a, b), "audit").select(F.col("file").alias("f"), F.col("offset").alias("o"), "status")
    rows = a.where("level = -1")
    joined = rows.join(found, (rows["file"] == found["f"]) & (rows["at"] == found["o"]), "left")
    return joined.select("page_id", "file", F.col("at").alias("offset"), "length", F.lower(F.hex("hash")).alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


def op6_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    return audited_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
