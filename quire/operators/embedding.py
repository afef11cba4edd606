"""Embedding operators.

``embed_texts`` runs a pluggable provider inside ``mapInArrow``: each task
feeds its rows to the provider in batches of ``batch_size`` (100, the
reference's request size), retries a failing batch with linear waits, checks
the count, and L2-normalises. A failure is recorded per row (``embed_error``)
instead of failing the whole job, so good rows are kept and bad ones can be
quarantined.

The default provider is offline and deterministic: a hashed bag of words
(bucket = first 8 hex digits of ``md5(token)`` mod ``dims``), which any SQL
engine with ``md5`` can reproduce.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from typing import Callable, Iterable, Iterator, Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.chunking import text_slices

# Fixed values
BATCH_SIZE = 100
RETRY_WAITS = (2.0, 4.0)  # seconds before the second and the third attempt
DOCUMENT_TASK = "RETRIEVAL_DOCUMENT"
QUERY_TASK = "RETRIEVAL_QUERY"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"  # Spark/RE2 spelling of the token separator


T_ = TypeVar("T_")


class EmbeddingError(Exception):
    pass


class _Md5Prefixes(dict):
    """First 8 hex digits of md5(token) as an integer, by token; a worker holds ``most`` of them."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[token] = int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big")
        return n


_md5_prefix = _Md5Prefixes().__getitem__


class Provider(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str], task_type: str) -> np.ndarray: ...


class HashingProvider:
    """Hashed bag of words; ``task_type`` does not change the vector."""

    _words = re.compile(r"[^\W_]+")  # Python: letters and numbers
    _ascii = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))  # the same for ASCII texts, faster

    def __init__(self, dims: int = 64):
        if dims <= 0:
            raise ValueError("dims must be greater than 0.")
        self.dims = dims
        self.name = f"hashing-md5-{dims}"

    def tokens(self, text: str) -> list[str]:
        text = (text or "").lower()
        return text.translate(self._ascii).split() if text.isascii() else self._words.findall(text)

    def bucket(self, token: str) -> int:
        return _md5_prefix(token) % self.dims

    def embed(self, texts: list[str], task_type: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        d = self.dims
        for i, text in enumerate(texts):
            tokens = self.tokens(text)
            if tokens:
                out[i] = np.bincount(np.fromiter(map(_md5_prefix, tokens), np.int64, len(tokens)) % d, minlength=d)
        return out


def _normalise(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(mat, axis=1)
    ok = norms > 0
    unit = np.zeros_like(mat)
    unit[ok] = mat[ok] / norms[ok, None]
    return unit.astype(np.float32), ok


class RetriesExhausted(Exception):
    """All tries failed; ``causes`` holds every failure."""

    def __init__(self, causes: list[Exception]):
        super().__init__(str(causes[-1]))
        self.causes = causes


def with_retries(call: Callable[[], T_], waits: Iterable[float], sleep: Callable[[float], None]) -> T_:
    """The result of ``call``, tried again after each of ``waits`` (seconds)."""
    causes: list[Exception] = []
    for wait in (0.0, *waits):
        if causes:
            sleep(wait)
        try:
            return call()
        except Exception as exc:  # noqa: BLE001 - a provider's errors are transient until proven otherwise
            causes.append(exc)
    raise RetriesExhausted(causes)


def embed_batch(provider: Provider, texts: list[str], task_type: str, offset: int, sleep=time.sleep, waits: Iterable[float] = RETRY_WAITS) -> np.ndarray:
    """The vectors of one request; a wrong number of them is final."""
    if not texts:
        raise EmbeddingError("Nothing to embed: received an empty list of texts.")
    where = f"(batch starting at chunk {offset})"
    try:
        mat = np.asarray(with_retries(lambda: provider.embed(texts, task_type), waits, sleep), dtype=np.float64)
    except RetriesExhausted as exc:
        raise EmbeddingError(f"Embedding request failed after {len(exc.causes)} attempts {where}: {exc}") from exc
    got = len(mat) if mat.ndim == 2 else 0
    if got != len(texts):
        raise EmbeddingError(f"Provider returned {got} embeddings for {len(texts)} inputs {where}.")
    if mat.shape[1] != provider.dims:
        raise EmbeddingError(f"Provider returned width {mat.shape[1]}, expected {provider.dims}.")
    return mat


def _embed_rows(provider: Provider, texts: list[str], task_type: str, batch_size: int, waits: Iterable[float], first: int) -> tuple[np.ndarray, list[str | None]]:
    """Unit vectors and errors of consecutive rows, in requests of ``batch_size``."""
    vecs = np.zeros((len(texts), provider.dims), np.float32)
    errors: list[str | None] = [None] * len(texts)
    for lo in range(0, len(texts), batch_size):
        some = [t or "" for t in texts[lo : lo + batch_size]]
        try:
            unit, ok = _normalise(embed_batch(provider, some, task_type, first + lo, waits=waits))
            vecs[lo : lo + len(some)] = unit
            for j in np.flatnonzero(~ok):
                errors[lo + j] = "Provider returned a zero-magnitude embedding."
        except EmbeddingError as exc:
            errors[lo : lo + len(some)] = [str(exc)] * len(some)
    return vecs, errors


def _with_vectors(rows: pa.Table, vecs: np.ndarray, errors: list[str | None]) -> Iterator[pa.RecordBatch]:
    dims = vecs.shape[1]
    offsets = pa.array(np.arange(0, (rows.num_rows + 1) * dims, dims, dtype=np.int32))
    emb = pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel(), pa.float32()), mask=pa.array([e is not None for e in errors]))
    yield from rows.append_column("embedding", emb).append_column("embed_error", pa.array(errors, pa.string())).to_batches()


def _embed_partition(provider: Provider, text_idx: int, task_type: str, batch_size: int, waits: Iterable[float], doc_idx: int | None):
    def rows_alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for rb in batches:
            if rb.num_rows:
                yield from _with_vectors(pa.Table.from_batches([rb]), *_embed_rows(provider, rb.column(text_idx).to_pylist(), task_type, batch_size, waits, seen))
                seen += rb.num_rows

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's rows stand together; those at a batch's end wait for the next."""
        held: list[pa.Table] = []
        key = None
        for rb in itertools.chain(text_slices(batches, text_idx), [None]):
            mine = [] if rb is None else rb.column(doc_idx).to_pylist()
            table = held + ([] if rb is None else [pa.Table.from_batches([rb])])
            if not table:
                return
            if held and mine and all(k == key for k in mine):  # the same document goes on
                held = table
                continue
            table = pa.concat_tables(table)
            keys = [key] * (table.num_rows - len(mine)) + mine
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            whole = cuts if rb is None else cuts[:-1]
            vecs, errors, texts = [], [], table.column(text_idx).to_pylist()
            for lo, hi in zip(whole, whole[1:]):
                v, e = _embed_rows(provider, texts[lo:hi], task_type, batch_size, waits, 0)
                failed = next((x for x in e if x is not None), None)
                vecs.append(v)
                errors += e if failed is None else [failed] * len(e)
            if errors:
                yield from _with_vectors(table.slice(0, whole[-1]), np.concatenate(vecs), errors)
            held, key = ([table.slice(whole[-1])], keys[-1]) if rb is not None else ([], None)

    return rows_alone if doc_idx is None else documents


# E2 (+E1 batching, E4 normalisation, E6 task type)
def embed_texts(
    df: DataFrame,
    text_col: str = "chunk_text",
    provider: Provider | None = None,
    task_type: str = DOCUMENT_TASK,
    batch_size: int = BATCH_SIZE,
    document_col: str | None = None,
    waits: Iterable[float] = RETRY_WAITS,
) -> DataFrame:
    """Append ``embedding ARRAY<FLOAT>`` (unit length, null on failure) and
    ``embed_error``. Narrow: runs where the rows already are.

    With ``document_col`` requests never span documents (whose rows must stand
    together, as chunking leaves them), and one failed chunk fails its document whole:
    no document is ever left with holes. A task then holds one document's chunks."""
    provider = provider or HashingProvider()
    idx = df.columns.index(text_col)
    schema = T.StructType(
        df.schema.fields
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
            T.StructField("embed_error", T.StringType(), True),
        ]
    )
    doc_idx = df.columns.index(document_col) if document_col else None
    return df.mapInArrow(_embed_partition(provider, idx, task_type, batch_size, tuple(waits), doc_idx), schema)


def check_same_space(doc_provider: Provider, query_provider: Provider) -> None:
    """Documents and queries use different task types but must come from
    the same provider at the same width, or similarities are meaningless."""
    if doc_provider.name != query_provider.name or doc_provider.dims != query_provider.dims:
        raise EmbeddingError(
            f"Query embeddings ({query_provider.name}, {query_provider.dims}) do not match "
            f"document embeddings ({doc_provider.name}, {doc_provider.dims})."
        )


def embed_query(text: str, provider: Provider | None = None) -> list[float]:
    """Embed one search query (driver side, one short text) with the query task."""
    provider = provider or HashingProvider()
    mat = embed_batch(provider, [text], QUERY_TASK, 0)
    unit, ok = _normalise(mat)
    if not ok[0]:
        raise EmbeddingError("Provider returned a zero-magnitude embedding.")
    return [float(x) for x in unit[0]]


# E1
def assign_batches(chunks: DataFrame, batch_size: int = BATCH_SIZE, keys=("doc_id", "split_strategy")) -> DataFrame:
    """Consecutive request batches per document in chunk order (no global
    ordering needed: the chunk index is already the document position)."""
    b = F.floor(F.col("chunk_index") / batch_size).cast("int")
    return chunks.groupBy(*keys, b.alias("batch_no")).agg(
        F.count(F.lit(1)).alias("n_in_batch"), F.min("chunk_index").alias("batch_offset")
    )


# E5
def check_vectors(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """One vector per chunk and the schema width: full outer join on id."""
    j = chunks.select("id", F.lit(True).alias("__c")).join(
        vectors.select("id", F.size("embedding").alias("width")), "id", "full_outer"
    )
    status = (
        F.when(F.col("__c").isNull(), "vector_without_chunk")
        .when(F.col("width").isNull(), "chunk_without_vector")
        .when(F.col("width") != dims, "wrong_width")
        .otherwise("ok")
    )
    return j.select("id", "width", status.alias("status"))
