"""Publication, build, configuration and DOCX queries."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.migrations import migrate, read_table, store_tables
from ..functions.storage import work_folder
from ..operators import snapshot as N
from ..operators.build import build, read_documents
from ..operators.build import published as current_build
from ..operators.vectors import hashed_bow
from ..sources.artifacts import read_snapshot
from ..sources.uploads import docx_units, model_of, parse_config, parsed
from .elements import elements


def published(spark: SparkSession, d: str, times: int = 1) -> str:
    root = work_folder(spark, "snapshot")
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    manifest = e.agg(F.count(F.lit(1)).alias("chunk_count"))
    for _ in range(times):
        N.publish(e.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("v")), manifest, root)
    return root


@query("K1_publish_version", "SELECT vec_id AS chunk_id, label FROM embeddings")
def k1(spark, d):
    return read_snapshot(spark, published(spark, d)).select("chunk_id", "label")


@query("K2_version_gc", "SELECT label, count(*) AS n, 1::BIGINT AS versions FROM embeddings GROUP BY 1")
def k2(spark, d):
    """After two publications one version is left, the one that the pointer names."""
    root = published(spark, d, 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    versions = files.select(F.regexp_extract("path", r"/(v\d+-\w+)/vectors/", 1).alias("version")).distinct().agg(F.count(F.lit(1)).alias("versions"))
    return read_snapshot(spark, root).groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(versions), F.lit(True))


@query("K4_chunk_artifacts", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def k4(spark, d):
    """JSON lines in a folder per collection, and what they hold when read back."""
    path = work_folder(spark, "artifacts")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.select("source", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "n_chars", "text").write.partitionBy("source").json(path)
    back = spark.read.schema("chunk_id string, n_chars long, text string, source string").json(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("K9_output_guard", "SELECT doc_id, doc_id % 4 IN (1, 3) AS allowed FROM documents")
def k9(spark, d):
    """Outputs may not lie in the data folder, however their path is written."""
    k, name = F.col("doc_id") % 4, F.concat(F.lit("/x"), F.col("doc_id").cast("string"))
    path = F.concat(F.when(k == 0, "/repo/./data").when(k == 1, "/repo/database").when(k == 2, "/repo//out/../data").otherwise("/repo/data/../out"), name)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (~N.inside(path, "/repo/data")).alias("allowed"))


#: Buckets of the queries' builds, whose tables are small.
_BUCKETS = 64
FINGERPRINT = {"chunker_version": "1", "embedding_model": "words by CRC-32"}


def revisions(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("document_id"), F.sha1(F.coalesce("text", F.lit(""))).alias("revision"))


@query("V7_full_build")
def v7(spark, d):
    """Every stage of a build over all documents; the greedy chunker has no SQL twin."""
    root = work_folder(spark, "build")
    build(revisions(spark, d), elements(spark, d), root, FINGERPRINT, hashed_bow, buckets=_BUCKETS)
    listed = read_documents(spark, current_build(spark, root))
    return listed.select("document_id", "chunk_count", F.when(F.col("chunk_count") > 0, "ready").otherwise("empty").alias("status"))


_MUTATED = f"""WITH p AS (SELECT doc_id AS document_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % {_BUCKETS} AS bucket,
 CASE WHEN doc_id % 83 = 0 THEN 'deleted' WHEN doc_id % 89 = 0 THEN 'new_document' WHEN doc_id % 97 = 0 THEN 'revision_changed' ELSE 'reused' END AS reason
 FROM documents WHERE NOT (doc_id % 83 = 0 AND doc_id % 89 = 0))
SELECT *, bool_or(reason <> 'reused') OVER (PARTITION BY bucket) AS rewritten FROM p"""


@query("V7_incremental_build", _MUTATED)
def v7_incremental(spark, d):
    """A build of all documents but every 89th, some of an older revision, and the build after it without
    every 83rd: why each document was made again or not, and whether its bucket's rows were written."""
    root, k = work_folder(spark, "build"), F.col("document_id")
    now = revisions(spark, d)
    old = now.where(k % 89 != 0).withColumn("revision", F.when(k % 97 == 0, "old").otherwise(F.col("revision")))
    build(old, elements(spark, d), root, FINGERPRINT, hashed_bow, buckets=_BUCKETS)
    after = build(now.where(k % 83 != 0), elements(spark, d), root, FINGERPRINT, hashed_bow, buckets=_BUCKETS)
    made = spark.read.parquet(f"{root}/{after.version}/plan")
    return made.select("document_id", "bucket", "reason", F.col("bucket").isin(sorted(after.written_buckets)).alias("rewritten"))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes(lines: list[str], every: int = 4) -> bytes:
    """A DOCX whose paragraphs are the lines, with a page break before every ``every``-th."""
    body = "".join(f"<w:p>{'<w:pPr><w:pageBreakBefore/></w:pPr>' if k and k % every == 0 else ''}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for k, t in enumerate(lines))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return raw.getvalue()


@query("S6_docx_body_scan", "WITH l AS (SELECT doc_id AS document_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents) SELECT document_id, (k // 4 + 1)::INT AS page, count(*) AS units FROM l GROUP BY 1, 2")
def s6(spark, d):
    def run(pdfs):
        for pdf in pdfs:
            rows = [(doc, page) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for _, page, _ in docx_units(docx_bytes((text or "").split("\n")))]
            yield pd.DataFrame(rows, columns=["document_id", "page"]).astype({"document_id": "int64", "page": "int32"})

    units = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").mapInPandas(run, "document_id long, page int")
    return units.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("units"))


@query("S3_docx_parse", "WITH l AS (SELECT doc_id AS document_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS text FROM documents) SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS ordinal, 'paragraph' AS type, text FROM l WHERE text <> ''")
def s3_docx(spark, d):
    """The lines of every document as the paragraphs of a DOCX file, and the items read from it."""

    def made(pdfs):
        for whole in pdfs:
            for a in range(0, len(whole), 256):
                pdf = whole.iloc[a : a + 256]
                yield pd.DataFrame({"document_id": pdf["doc_id"], "content": [docx_bytes((t or "").split("\n")) for t in pdf["text"]]})

    files = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").mapInPandas(made, "document_id long, content binary")
    return parsed(files.withColumn("kind", F.lit("docx"))).select("document_id", "ordinal", "type", "text")


@query("S18_role_config", "SELECT event_id, CASE event_type WHEN 'view' THEN 'small' WHEN 'error' THEN 'large' ELSE 'base' END AS model FROM events")
def s18(spark, d):
    """Each call takes the model of its role; roles without one have the default's."""
    config = parse_config('[roles]\ndefault = "base"\nview = "small"\nerror = "large"\n')
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", model_of(F.col("event_type"), config).alias("model"))


@query("D11_schema_migrations", "SELECT conv_id AS session_id, max(turn)::VARCHAR AS updated_at, NULL::VARCHAR AS scope_json, 0 AS summary_failures, 3 AS version FROM conversations GROUP BY 1")
def d11(spark, d):
    """A table of version 1 gets what versions 2 and 3 added."""
    root = work_folder(spark, "state")
    first = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").cast("string").alias("updated_at"))
    store_tables(spark, root, {"sessions": first}, 1)
    version = migrate(spark, root)
    return read_table(spark, root, "sessions").withColumn("version", F.lit(version))
