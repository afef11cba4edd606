"""The indexing flow and the flagship query.

documents -> clean (T9) -> reflow (T12) -> chunk (C8) -> embed (E2, hashed
provider, normalised) -> ids (S8) -> chunk table; search embeds the query text
with the query task type and takes the exact top-k (Q2).

Every step up to the embedding is narrow (row-local), so the whole indexing
flow runs without a shuffle; ``repartition`` by document only spreads large
inputs evenly before the Python kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunking as C
from quire.operators import embedding as E
from quire.operators import retrieval as R
from quire.sources import store as S
from quire.sources.tables import read_table

FLAGSHIP_STRATEGY = "paragraph"
FLAGSHIP_QUERY_ITEM = 0
DIMS = 64


def prepare_documents(docs: DataFrame, text_col: str = "text", reflow: bool = True) -> DataFrame:
    cleaned = docs.withColumn(text_col, X.clean_text(F.col(text_col)))
    return X.reflow_paragraphs(cleaned, text_col) if reflow else cleaned


def index_documents(
    docs: DataFrame,
    strategy: str = FLAGSHIP_STRATEGY,
    chunk_size: int = C.DEFAULT_CHUNK_SIZE,
    overlap: int = C.DEFAULT_OVERLAP,
    provider: E.Provider | None = None,
    waits: tuple[float, ...] = E.RETRY_WAITS,
) -> DataFrame:
    """Rows of the chunk table (plus ``doc_id`` and ``embed_error``). A document with a
    chunk that cannot be embedded has the error on all its rows, so what is left out
    (or quarantined by ``upsert_chunks``) is always a whole document."""
    provider = provider or E.HashingProvider(DIMS)
    prepared = prepare_documents(docs.select("doc_id", "text"))
    chunks = C.chunk_text(prepared, "text", strategy, chunk_size, overlap, keep=["doc_id"])
    chunks = chunks.withColumn("filename", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    embedded = E.embed_texts(chunks, "chunk_text", provider, E.DOCUMENT_TASK, document_col="doc_id", waits=waits)
    return S.assign_ids(embedded, "doc_id")


def flagship(spark: SparkSession, sf_dir: str, k: int = R.DEFAULT_TOP_K) -> DataFrame:
    provider = E.HashingProvider(DIMS)
    docs = read_table(spark, sf_dir, "documents")
    index = index_documents(docs, provider=provider).where(F.col("embed_error").isNull())
    text = read_table(spark, sf_dir, "benchmark").where(F.col("item_id") == FLAGSHIP_QUERY_ITEM).first()["text"]
    R.validate_query(text, k)
    query_provider = E.HashingProvider(DIMS)
    E.check_same_space(provider, query_provider)
    qv = E.embed_query(text, query_provider)
    return R.search_topk(index, qv, k)
