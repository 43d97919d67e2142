"""Incremental builds of the index: only buckets with a changed document are made again.

Documents fall into buckets by a hash of their id.  A version is a folder with the chunks and vectors of the
buckets that it wrote, the list of all documents with revision and number of chunks, and a layout: for
every bucket the version that wrote it last.  A build compares the registry with the published documents,
chunks and embeds what is new or changed, takes the other documents' rows of a touched bucket from the
version before, and leaves untouched buckets where they are.  The pointer moves last and only under a
lock whose token is newer than what is published.  A version is deleted once no bucket of the published
layout is in it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locks import Lock, StaleToken, acquire, create_file, file_system, read_file, replace_file
from . import chunks as C
from . import elements as E
from .snapshot import reuse_plan

BUCKETS = 256
#: Changed documents (some 40 bytes each) up to which they are broadcast.
MAX_BROADCAST = 200_000
#: Why a document is not the same as before, and why it is.
ALL_REASONS = ("reused", "new_document", "revision_changed", "chunks_unreadable", "count_mismatch", "fingerprint_changed", "deleted")


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(document_id.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % buckets).cast("int")


@dataclass
class Published:
    """What the pointer names; version is None before the first build."""

    root: str
    version: str | None = None
    token: int = 0
    fingerprint: dict = field(default_factory=dict)
    #: Of each bucket the version whose folder has it.
    layout: dict[int, str] = field(default_factory=dict)
    dimension: int | None = None

    def folder(self, version: str) -> str:
        return f"{self.root}/{version}"


def published(spark: SparkSession, root: str) -> Published:
    """The published version; one whose pointer or manifest can't be read counts as none."""
    try:
        pointer = json.loads(read_file(spark, f"{root}/current.json") or "{}")
        version = pointer.get("version")
        manifest = json.loads(read_file(spark, f"{root}/{version}/manifest.json") or "null") if version else None
        token = int(pointer.get("token") or 0)
    except (ValueError, TypeError, AttributeError):
        return Published(root)
    if not manifest:
        return Published(root, token=token)
    return Published(root, version, token, manifest["fingerprint"], {int(b): v for b, v in manifest["layout"].items()}, manifest.get("dimension"))


def _bucket_folders(spark: SparkSession, state: Published) -> dict[int, str]:
    """The folders of the layout's buckets that are there; a bucket without rows has none to read."""
    fs, p = file_system(spark, state.root)
    folders = {b: f"{state.folder(v)}/chunks/bucket={b}" for b, v in state.layout.items()}
    return {b: f for b, f in folders.items() if fs.exists(p(f))}


def read_chunks(spark: SparkSession, state: Published, buckets: set[int] | None = None) -> DataFrame | None:
    """All chunks of the published version, or those of some buckets; None where there are no files."""
    folders = [f for b, f in _bucket_folders(spark, state).items() if buckets is None or b in buckets]
    return spark.read.parquet(*folders) if folders else None


def read_documents(spark: SparkSession, state: Published) -> DataFrame | None:
    return spark.read.parquet(f"{state.folder(state.version)}/documents") if state.version else None


def all_chunks(elements: DataFrame) -> DataFrame:
    """(document_id, chunk_type, anchor, last, piece, retrieval_text): prose packed with overlap, and each
    formula and figure, and the rows of each table packed, as chunks of their own.  Elements that the
    policy of roles drops are left out; a table is a run of table rows."""
    have = set(elements.columns)
    none = F.lit(None).cast("string")
    rows = elements.withColumns({c: none for c in ("search_text", "latex", "context", "parse_status", "caption", "path", "role", "index_policy") if c not in have})
    rows = C.policy(rows).where("fate = 'kept'").drop("fate")
    rows = rows if "element_id" in have else rows.withColumn("element_id", F.concat(F.lit("e"), F.col("ordinal").cast("string")))
    prose = C.prose_chunks(rows).select("document_id", F.lit("prose").alias("chunk_type"), F.col("first").alias("anchor"), "last", "piece", F.col("text").alias("retrieval_text"))
    one = lambda df, kind: df.select("document_id", F.lit(kind).alias("chunk_type"), F.col("ordinal").alias("anchor"), F.col("ordinal").alias("last"), F.lit(0).alias("piece"), "retrieval_text")
    is_row = F.col("type") == "table"
    opens = is_row & ~F.coalesce(F.lag("type").over(E.doc_order()) == "table", F.lit(False))
    lines = rows.select("document_id", "ordinal", "type", F.when(is_row, F.col("text")).alias("text"))
    tables = lines.withColumn("opens", opens.cast("int")).withColumn("table_no", F.sum("opens").over(E.upto())).where(is_row)
    packs = C.table_packs(tables, ["document_id", "table_no"], "ordinal", "text")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n")
    packs = packs.groupBy("document_id", "table_no", "pack").agg(F.min("ordinal").alias("anchor"), F.max("ordinal").alias("last"), line.alias("retrieval_text"))
    packs = packs.select("document_id", F.lit("table_pack").alias("chunk_type"), "anchor", "last", F.col("pack").alias("piece"), "retrieval_text")
    made = prose.unionByName(one(C.formula_chunks(rows), "formula")).unionByName(one(C.figure_chunks(rows), "figure")).unionByName(packs)
    return made.withColumn("retrieval_text", C.clamp(F.col("retrieval_text"))).where("retrieval_text <> ''")


def identified(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """all_chunks with chunk_id."""
    ids = F.array(F.concat(F.lit("e"), F.col("anchor").cast("string")), F.concat(F.lit("e"), F.col("last").cast("string")))
    named = chunks.join(documents.select("document_id", "revision"), "document_id")
    named = named.withColumn("chunk_id", C.chunk_id(F.col("document_id"), F.col("revision"), F.col("chunk_type"), ids, F.col("piece"), F.col("retrieval_text")))
    return named.select("document_id", "chunk_id", "chunk_type", "anchor", "last", "piece", "retrieval_text")


def with_neighbours(named: DataFrame) -> DataFrame:
    """Chunks with the ids of the nearest prose chunks before and after each structural one."""
    prose = F.col("chunk_type") == "prose"
    near = C.neighbors(named.select("document_id", "chunk_id", "anchor", prose.alias("prose")))
    near = near.select("document_id", "chunk_id", F.col("prev").alias("prev_ids"), F.col("next").alias("next_ids"))
    # Prose has no neighbours, so its texts need not meet them.
    return named.where(~prose).join(near, ["document_id", "chunk_id"], "left").unionByName(named.where(prose), allowMissingColumns=True)


def plan(spark: SparkSession, documents: DataFrame, state: Published, fingerprint: dict, buckets: int, reuse: bool = True) -> DataFrame:
    """(document_id, revision, bucket, reason) of every current document, and of deleted ones with a null
    revision.  What is stored is counted anew: a document whose rows are gone is made again."""
    now = documents.select("document_id", "revision", bucket_of(F.col("document_id"), buckets).alias("bucket"))
    before = read_documents(spark, state)
    if before is None:
        return now.withColumn("reason", F.lit("new_document"))
    stored = read_chunks(spark, state)
    if stored is None:
        counts = before.select("document_id", F.lit(None).cast("long").alias("chunk_count")).limit(0)
    else:
        counts = stored.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    # A document without chunks has no rows to lose.
    counted = now.join(counts, "document_id", "left").join(before.select("document_id", F.col("chunk_count").alias("was")), "document_id", "left")
    counted = counted.select("document_id", "revision", "bucket", F.when(F.col("was") == 0, F.coalesce("chunk_count", F.lit(0))).otherwise(F.col("chunk_count")).alias("chunk_count"))
    same = F.lit(reuse and state.fingerprint == fingerprint and len(state.layout) == buckets)
    reasons = reuse_plan(counted, before, same).join(now, "document_id")
    gone = before.join(now.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(None).cast("string").alias("revision"), bucket_of(F.col("document_id"), buckets).alias("bucket"), F.lit("deleted").alias("reason"))
    return reasons.select("document_id", "revision", "bucket", "reason").unionByName(gone)


@dataclass
class Built:
    """What a build did; counts are of documents, chunks and buckets."""

    version: str
    previous: str | None
    reasons: dict[str, int]
    written_buckets: set[int]
    chunk_count: int
    embedded_chunks: int
    reused_chunks: int


def _by_bucket(df: DataFrame) -> DataFrame:
    # A bucket is one task's and one file, unless adaptive execution finds it large and splits it.
    return df.hint("rebalance", "bucket")


def build(
    documents: DataFrame, elements: DataFrame, root: str, fingerprint: dict, embed: Callable[[Column], Column],
    chunk: Callable[[DataFrame], DataFrame] = all_chunks, buckets: int = BUCKETS, lock: Lock | None = None,
) -> Built:
    """Builds the version after the published one from documents (document_id, revision) and their
    elements.  chunk and embed run for changed documents only."""
    spark = documents.sparkSession
    with lock or acquire(spark, f"{root}/.build.lock", published(spark, root).token) as held:
        return _build(documents, elements, root, fingerprint, embed, chunk, buckets, held)


def _build(documents, elements, root, fingerprint, embed, chunk, buckets, held: Lock, reuse: bool = True) -> Built:
    spark = documents.sparkSession
    state = published(spark, root)
    version = f"v{held.token:010d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/{version}"
    fs, p = file_system(spark, root)
    try:
        # The plan is written once: reasons, buckets and rows all follow from the same one.
        plan(spark, documents, state, fingerprint, buckets, reuse).write.parquet(f"{folder}/plan")
        made = spark.read.parquet(f"{folder}/plan")
        summary = made.groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("n")).collect()  # at most buckets times reasons
        reasons: dict[str, int] = {}
        for row in summary:
            reasons[row["reason"]] = reasons.get(row["reason"], 0) + row["n"]
        touched = {r["bucket"] for r in summary if r["reason"] != "reused"} | ({*range(buckets)} if len(state.layout) != buckets else set())
        changed = made.where(~F.col("reason").isin("reused", "deleted")).select("document_id", "revision")
        n_changed = sum(n for reason, n in reasons.items() if reason not in ("reused", "deleted"))
        n_same = sum(reasons.values()) - n_changed
        few = F.broadcast(changed) if n_changed <= MAX_BROADCAST else changed
        # Elements of other documents are dropped where chunks get their revision; to leave them out before is cheaper
        # unless that itself takes a shuffle of all texts.
        if n_changed > MAX_BROADCAST >= n_same:
            others = made.where(F.col("reason").isin("reused", "deleted")).select("document_id")
            wanted = elements.join(F.broadcast(others), "document_id", "left_anti") if n_same else elements
        else:
            wanted = elements.join(few.select("document_id"), "document_id", "left_semi")
        # Written once: the neighbours are found in it, and then it is embedded.
        identified(chunk(wanted), few).write.parquet(f"{folder}/fresh")
        fresh = with_neighbours(spark.read.parquet(f"{folder}/fresh"))
        fresh = fresh.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
        embedded = lambda df: df.withColumn("v", embed(F.col("retrieval_text"))).withColumn("made_in", F.lit(version))
        old = read_chunks(spark, state, touched)
        if old is not None and reasons.get("reused"):
            stay = made.where((F.col("reason") == "reused") & F.col("bucket").isin(sorted(touched))).select("document_id")
            kept = old.join(stay, "document_id", "left_semi").withColumn("bucket", bucket_of(F.col("document_id"), buckets))
            rows = _by_bucket(embedded(fresh).unionByName(kept))
        else:
            rows = embedded(_by_bucket(fresh))  # texts move to their buckets without vectors
        if touched:
            rows.write.partitionBy("bucket").parquet(f"{folder}/chunks")
        fs.delete(p(f"{folder}/fresh"), True)
        layout = {b: version if b in touched else state.layout[b] for b in range(buckets)}
        now = Published(root, version, held.token, fingerprint, layout)
        stored = read_chunks(spark, now)
        total, n_embedded, dimension, sizes = 0, 0, None, 0
        if stored is not None:
            size = F.size("v")
            total, n_embedded, dimension, sizes = stored.agg(F.count(F.lit(1)), F.count_if(F.col("made_in") == version), F.max(size), F.count_distinct(size)).first()
        if sizes > 1 and reuse:
            # The embedder's dimension changed though the fingerprint did not: nothing may be reused.
            fs.delete(p(folder), True)
            return _build(documents, elements, root, fingerprint, embed, chunk, buckets, held, reuse=False)
        counts = stored.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")) if stored is not None else None
        listed = made.where("reason <> 'deleted'")
        listed = listed.join(counts, "document_id", "left") if counts is not None else listed.withColumn("chunk_count", F.lit(None).cast("long"))
        listed = listed.select("document_id", "revision", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
        listed.write.parquet(f"{folder}/documents")
        manifest = {"version": version, "previous": state.version, "fingerprint": fingerprint, "layout": layout, "dimension": dimension, "chunk_count": total, "reasons": reasons}
        create_file(spark, f"{folder}/manifest.json", json.dumps(manifest))
        point(spark, root, version, held)
    except Exception:
        fs.delete(p(folder), True)
        raise
    collect_versions(spark, now)
    return Built(version, state.version, reasons, touched, total, n_embedded, total - n_embedded)


def point(spark: SparkSession, root: str, version: str, held: Lock) -> None:
    """Moves the pointer to a version, unless something newer is published or the lock is lost."""
    if published(spark, root).token > held.token or not held.held():
        raise StaleToken(f"{version}: token {held.token}")
    following = f"{root}/.current-{held.owner}"
    create_file(spark, following, json.dumps({"version": version, "token": held.token, "at": time.time()}))
    replace_file(spark, following, f"{root}/current.json")


def collect_versions(spark: SparkSession, state: Published) -> list[str]:
    """Deletes versions that neither the pointer nor a bucket of its layout names, and in older ones the
    buckets, plans and lists that are no longer read; returns the deleted versions."""
    fs, p = file_system(spark, state.root)
    needed: dict[str, set[int]] = {state.version: set()}
    for b, v in state.layout.items():
        needed.setdefault(v, set()).add(b)
    gone = []
    for status in fs.listStatus(p(state.root)):
        name = status.getPath().getName()
        if not name.startswith("v") or not status.isDirectory():
            continue
        if name not in needed:
            fs.delete(status.getPath(), True)
            gone.append(name)
        elif name != state.version:
            for part in ("plan", "documents"):
                fs.delete(p(f"{state.root}/{name}/{part}"), True)
            chunks = p(f"{state.root}/{name}/chunks")
            for held in fs.listStatus(chunks) if fs.exists(chunks) else []:
                found = held.getPath().getName()
                if found.startswith("bucket=") and int(found[7:]) not in needed[name]:
                    fs.delete(held.getPath(), True)
    return gone


def quality(chunks: DataFrame) -> DataFrame:
    """Per document and over all (null document_id): chunks, and how many of each type."""
    kinds = ("prose", "formula", "figure", "table_pack")
    return chunks.rollup("document_id").agg(F.count(F.lit(1)).alias("chunks"), *(F.count_if(F.col("chunk_type") == k).alias(k) for k in kinds))

