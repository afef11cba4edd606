"""Registered source, streaming and SQL-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import sql as QS
from quire.operators import structure as ST
from quire.plans import oracle as O
from quire.plans.registry import register
from quire.plans.q_chunking import _ALL_SQL, OVERLAP, SIZE, _chunk_sql, prepared
from quire.session import shared_dir
from quire.sources import files as FS
from quire.sources import store as S
from quire.sources.tables import TABLES, read_table


@register(
    "scan_sources",
    " UNION ALL ".join(f"SELECT '{t}.parquet' AS source, TRUE AS has_bytes, count(*) AS n_rows FROM {t}" for t in TABLES),
)
def scan_sources(spark, sf_dir):
    """The driver tables as files (listed, no bytes read), by table, beside the number of
    rows that reading them finds."""
    files = FS.scan_sources(spark, sf_dir, "*.parquet")
    source = F.regexp_extract("path", r"([^/]+\.parquet)(?:/[^/]+)?$", 1)
    listed = files.groupBy(source.alias("source")).agg((F.sum("length") > 0).alias("has_bytes"))
    rows = None
    for t in TABLES:
        one = read_table(spark, sf_dir, t, spread=False).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"{t}.parquet").alias("source"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return listed.join(rows, "source", "full")


_EXT = ["'.pdf'", "'.docx'", "'.PDF'", "''", "'.txt'", "'.Docx'"]


def _source_rows(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e.strip("'")) for e in _EXT]), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 17 == 0, F.lit(" \x07 ")).otherwise(F.col("text"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), ext).alias("path"),
        (F.col("doc_id") % 13 != 0).alias("exists"),
        text.alias("text"),
        # as an indexer that found nothing to pack in documents of one kind would report
        F.when(F.col("doc_id") % 19 == 0, 0).otherwise(1).alias("n_chunks"),
    )


@register(
    "validate_sources",
    f"""WITH s AS (SELECT doc_id, '/data/' || source || '/doc' || doc_id || ([{', '.join(_EXT)}])[doc_id % 6 + 1] AS path,
                      doc_id % 13 <> 0 AS exists_, CASE WHEN doc_id % 17 = 0 THEN ' ' || chr(7) || ' ' ELSE text END AS text,
                      CASE WHEN doc_id % 19 = 0 THEN 0 ELSE 1 END AS n_chunks FROM documents),
x AS (SELECT *, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS sfx,
             regexp_extract(path, '([^/]*)$', 1) AS name FROM s),
c AS (SELECT doc_id, path, sfx, name,
             CASE WHEN NOT exists_ THEN 'FileNotFoundError'
                  WHEN sfx NOT IN ('.docx', '.pdf') THEN 'UnsupportedFileTypeError'
                  WHEN {O.clean('text')} = '' THEN 'NoTextExtractedError'
                  WHEN n_chunks = 0 THEN 'NoChunksError' END AS error_class FROM x)
SELECT doc_id, path, error_class,
  CASE error_class WHEN 'FileNotFoundError' THEN 'File not found: ' || path
    WHEN 'UnsupportedFileTypeError' THEN 'Unsupported file type ''' || CASE WHEN sfx = '' THEN '(none)' ELSE sfx END
         || '''. Supported types: .docx, .pdf.'
    WHEN 'NoTextExtractedError' THEN 'No extractable text found in ' || name
         || '. If this is a scanned document it would need OCR, which is not supported.'
    WHEN 'NoChunksError' THEN 'The ''paragraph'' strategy produced no chunks from ' || name || '.' END AS error_message,
  CASE WHEN error_class IS NULL THEN 'ok' ELSE 'quarantined' END AS status
FROM c""",
)
def validate_sources(spark, sf_dir):
    return FS.validate_sources(_source_rows(spark, sf_dir), n_chunks="n_chunks", strategy="paragraph").select("doc_id", "path", "error_class", "error_message", "status")


@register(
    "assemble_pages",
    """SELECT conv_id AS doc_id,
       coalesce(string_agg(CASE WHEN role <> 'system' THEN coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn), '') AS text,
       count(*) FILTER (WHERE role <> 'system') AS n_pages
FROM conversations GROUP BY conv_id""",
)
def assemble_pages(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    pages = conv.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text", (F.col("role") == "system").alias("is_broken")
    )
    return ST.assemble_pages(pages)


@register(
    "table_rows_to_text",
    f"""WITH b AS (
  SELECT page_id // 10 AS doc_id, page_id, 0 AS g, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages
  UNION ALL
  SELECT page_id // 10, page_id, 1,
         array_to_string(list_filter(list_transform([url, '  ', trim(html)], lambda c: {O.strip('c')}),
                                     lambda c: c <> ''), ' | ') FROM pages)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY g, page_id) AS text FROM b WHERE t <> '' OR g = 0 GROUP BY doc_id""",
)
def table_rows_to_text(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    doc = (F.col("page_id") / 10).cast("long")
    paras = pages.select(doc.alias("doc_id"), F.col("page_id").alias("block_no"), F.lit("paragraph").alias("kind"),
                         F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"),
                         F.lit(None).cast("array<string>").alias("cells"))
    rows = pages.select(doc.alias("doc_id"), F.col("page_id").alias("block_no"), F.lit("table_row").alias("kind"),
                        F.lit(None).cast("string").alias("text"),
                        F.array("url", F.lit("  "), F.trim("html")).alias("cells"))
    return ST.blocks_to_text(paras.unionByName(rows))


def _incremental_sql() -> str:
    from quire.plans.q_index import _PREP, SIZE, OVERLAP, hashed_vectors_ctes
    from quire.sources.store import INDEX_BITS

    return f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')},{hashed_vectors_ctes('cp', ['doc_id', 'chunk_index'], 'chunk_text', 'hv')}
SELECT doc_id * {1 << (INDEX_BITS + 2)} + 2 * {1 << INDEX_BITS} + chunk_index AS id, 'doc' || doc_id AS filename,
       'paragraph' AS split_strategy, chunk_index, chunk_text
FROM cp JOIN hv USING (doc_id, chunk_index) WHERE doc_id NOT IN (SELECT doc_id FROM hv WHERE n = 0)"""


@register("incremental_index", _incremental_sql())
def incremental_index(spark, sf_dir):
    """Stream the documents file through the indexer (availableNow) into a
    chunk table in the shared checkpoint folder, twice: the second run finds
    no new files and the table is unchanged. The oracle is the table the
    batch indexer would produce."""
    from quire.streaming.incremental import incremental_index as run

    root = shared_dir(spark, "chunks")
    ckpt = shared_dir(spark, "stream-ckpt")
    for _ in range(2):
        q = run(spark, f"{sf_dir.rstrip('/')}/documents*.parquet", root, ckpt)
        q.awaitTermination()
    return S.read_chunks(spark, root, 64).select("id", "filename", "split_strategy", "chunk_index", "chunk_text")


@register("chunk_text_udtf", _chunk_sql("fixed"))
def chunk_text_udtf(spark, sf_dir):
    """``LATERAL chunk_text(...)`` over the prepared documents."""
    QS.register_chunk_udtf(spark)
    prepared(spark, sf_dir).createOrReplaceTempView("prepared_documents")
    return spark.sql(
        "SELECT d.doc_id, c.chunk_index, c.chunk_text FROM prepared_documents d, "
        "LATERAL chunk_text(d.text, 'fixed', 1000, 200) c"
    )


@register(
    "sql_functions",
    f"""WITH s AS (SELECT doc_id, {O.soil('text')} AS text, source FROM documents),
c AS (SELECT doc_id, text, {O.clean('text')} AS t, {O.strip("coalesce(text, '')")} AS m, source FROM s)
SELECT doc_id, t AS text, length({O.strip('text')}) AS stripped_len, {O.is_heading("split_part(t, chr(10), 1)")} AS heading_first,
  array_to_string({O.paragraphs_list('t')}, '|') AS paragraphs, array_to_string({O.sentences_list('t')}, '|') AS sentences,
  CASE WHEN contains(m, '://') THEN source || ' (details withheld: may contain credentials)'
       WHEN m = '' THEN source ELSE left(m, 300) END AS redacted
FROM c""",
)
def sql_functions(spark, sf_dir):
    """SQL-bodied temporary functions used from plain Spark SQL."""
    from quire.plans.fixtures import soil

    QS.register_sql_functions(spark)
    read_table(spark, sf_dir, "documents").select("doc_id", soil("text").alias("text"), "source").createOrReplaceTempView("soiled_documents")
    return spark.sql(
        "SELECT doc_id, t AS text, length(strip_text(text)) AS stripped_len, is_heading(split_part(t, char(10), 1)) AS heading_first, "
        "array_join(split_paragraphs(t), '|') AS paragraphs, array_join(split_sentences(t), '|') AS sentences, "
        "redact_error(text, source) AS redacted FROM (SELECT *, clean_text(text) AS t FROM soiled_documents)"
    )


@register(
    "read_docx",
    f"""SELECT doc_id, replace(regexp_replace(coalesce(text, ''), {O.q(FS.NO_XML)}, '', 'g'), chr(10), chr(10) || chr(10)) || chr(10) || chr(10)
       || source || ' | ' || lang AS text FROM documents""",
)
def read_docx(spark, sf_dir):
    """Each document written as a DOCX file - its lines as paragraphs, a table with its source and language and a blank
    row -, staged, and read back."""
    docs = read_table(spark, sf_dir, "documents")
    cell = lambda c: F.concat(F.lit("  "), F.col(c), F.lit(" "))
    rows = F.array(F.array(cell("source"), F.lit(""), cell("lang")), F.array(F.lit(" "), F.lit("")))
    made = FS.write_docx(docs, F.concat(F.lit("/docs/doc"), F.col("doc_id").cast("string"), F.lit(".docx")), F.split(F.coalesce("text", F.lit("")), "\n", -1), rows)
    path = shared_dir(spark, "docx")
    made.write.parquet(path)
    blocks = FS.read_docx(spark.read.schema("path string, content binary").parquet(path)).where("kind <> 'error'")
    return ST.blocks_to_text(blocks.withColumn("doc_id", F.regexp_extract("path", r"doc(-?\d+)\.docx$", 1).cast("long")))


@register("chunk_table_udtf", f"{_ALL_SQL}\nSELECT doc_id, split_strategy, chunk_index, chunk_text FROM allc")
def chunk_table_udtf(spark, sf_dir):
    """The polymorphic table function over prepared documents: the rows of ``chunk_all_strategies``."""
    QS.register_chunk_table(spark)
    prepared(spark, sf_dir).createOrReplaceTempView("prepared_documents")
    return spark.sql(f"SELECT doc_id, split_strategy, chunk_index, chunk_text FROM chunk_table(TABLE(SELECT doc_id, text FROM prepared_documents) PARTITION BY (doc_id), 'text', {SIZE}, {OVERLAP})")
