"""Retrieval: exact, filtered, batch and approximate cosine top-k (Q2-Q9).

Plans:

* ``search_topk`` - one query: per-row similarity projection, then
  ``orderBy(desc(similarity), id).limit(k)`` which Spark runs as
  ``TakeOrderedAndProject`` (k rows per partition, one small merge). Filters
  are added only when given, so they reach the Parquet scan / partition pruning.
* ``search_batch`` - many queries (a kNN join): blocks of queries meet blocks of chunks
  as cogrouped tasks, a matrix product and a running top-k each, so only ``k`` rows per
  query and block leave a task (no pair is ever a row). Windows on ``query_id`` merge them
  in two levels. With ``many`` (as many queries as chunks) a product in floats picks, with a margin over its
  rounding error, the pairs that can be among the best, and these are scored in doubles.
* ``search_approx`` - IVF: ``pyspark.ml`` KMeans assigns every chunk a cell;
  each query is scored only against the chunks of its ``n_probe`` nearest
  cells, with the same bounded-output kernel.
"""

from __future__ import annotations

import math
import textwrap
from typing import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import vectors as V
from quire.functions.text import WS, strip_text
from quire.session import shared_dir

DEFAULT_TOP_K = 5
PREVIEW_WIDTH = 340
PREVIEW_PLACEHOLDER = " ..."
MOST_RANKED = 10_000
# Bytes of query matrix we agree to ship to every task in one pass.
MAX_QUERY_BROADCAST_BYTES = 64 * 1024 * 1024

RESULT_COLUMNS = ["id", "chunk_text", "filename", "split_strategy", "chunk_index", "created_at", "similarity"]


# Q9
def validate_query(query: str | None, top_k: int) -> None:
    """Refuse blank queries and non-positive k before any work is planned."""
    if not (query or "").strip():
        raise ValueError("Error: --query must not be empty.")
    if top_k <= 0:
        raise ValueError("Error: --top-k must be greater than 0.")


def validate_queries(df: DataFrame, text_col: str = "query", k_col: str = "top_k") -> DataFrame:
    """Q9 over a table of requests: ``ok`` and the refusal message, per row."""
    blank = F.coalesce(F.length(strip_text(F.col(text_col))), F.lit(0)) == 0
    err = (
        F.when(blank, F.lit("Error: --query must not be empty."))
        .when(F.col(k_col) <= 0, F.lit("Error: --top-k must be greater than 0."))
    )
    return df.withColumn("error", err).withColumn("ok", F.col("error").isNull())


# Q3
def apply_filters(chunks: DataFrame, filename: str | None = None, split_strategy: str | None = None) -> DataFrame:
    """Optional equality filters; ``None`` means no filter (nothing is planned)."""
    if filename is not None:
        chunks = chunks.where(F.col("filename") == filename)
    if split_strategy is not None:
        chunks = chunks.where(F.col("split_strategy") == split_strategy)
    return chunks


# Q2 (+Q3)
def search_topk(
    chunks: DataFrame,
    query_vector: Sequence[float],
    k: int = DEFAULT_TOP_K,
    filename: str | None = None,
    split_strategy: str | None = None,
) -> DataFrame:
    """The k chunks most similar to ``query_vector`` (ties broken by id, null and zero
    vectors last): per-row cosine as a native expression, then
    ``TakeOrderedAndProject`` - one pass, all in the JVM, whatever the width."""
    if k <= 0:
        raise ValueError("top_k must be greater than 0.")
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = apply_filters(chunks, filename, split_strategy).withColumn("similarity", V.cosine_similarity(F.col("embedding"), q))
    return scored.orderBy(F.desc_nulls_last("similarity"), F.asc("id")).limit(k).select(*RESULT_COLUMNS)


# -- batch top-k --------------------------------------------------------------


def _best_of(col: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best rows by (-similarity, id); exact on boundary ties."""
    n = col.shape[0]
    if n > k:
        kth = np.partition(-col, k - 1)[k - 1]
        cand = np.nonzero(-col <= kth)[0]
    else:
        cand = np.arange(n)
    return cand[np.lexsort((ids[cand], -col[cand]))[:k]]


def _vectors(rb: pa.RecordBatch, col: int, dims: int) -> np.ndarray:
    """The batch's vectors; a null one is zero, so its similarity is null too."""
    arr = pc.fill_null(rb.column(col), pa.scalar([0.0] * dims, rb.column(col).type))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size != rb.num_rows * dims:
        raise ValueError(f"vector width differs from {dims} in this batch")
    return flat.reshape(rb.num_rows, dims)


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (x @ q.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1))
    return np.where(np.isfinite(s), s, -np.inf)


class _DenseTopK:
    """Best k per query when every row is scored against every query: one
    ``argpartition`` over the (rows x queries) block per Arrow batch, exact
    per-column fallback only where a tie straddles the k-th place."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.ids = np.empty((0, n_queries), np.int64)
        self.sims = np.empty((0, n_queries), np.float64)

    def offer_all(self, ids: np.ndarray, sims: np.ndarray) -> None:
        all_s = np.vstack([self.sims, sims])
        all_i = np.vstack([self.ids, np.broadcast_to(ids[:, None], sims.shape)])
        k = self.k
        if all_s.shape[0] <= k:
            self.ids, self.sims = all_i, all_s
            return
        neg = -all_s
        part = np.argpartition(neg, k - 1, axis=0)[:k]
        kth = np.take_along_axis(neg, part, axis=0).max(axis=0)
        keep_i = np.take_along_axis(all_i, part, axis=0)
        keep_s = np.take_along_axis(all_s, part, axis=0)
        for j in np.nonzero((neg <= kth).sum(axis=0) > k)[0]:  # boundary ties: decide by id
            pick = _best_of(all_s[:, j], all_i[:, j], k)
            keep_i[:, j], keep_s[:, j] = all_i[pick, j], all_s[pick, j]
        self.ids, self.sims = keep_i, keep_s

    def batch(self, qids: np.ndarray) -> pa.RecordBatch | None:
        if self.ids.shape[0] == 0:
            return None
        sim = self.sims.T.ravel()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(qids, self.ids.shape[0]), pa.int64()),
                pa.array(self.ids.T.ravel(), pa.int64()),
                pa.array(np.where(np.isfinite(sim), sim, np.nan), pa.float64(), from_pandas=True),
            ],
            names=["query_id", "id", "similarity"],
        )


KNN_SCHEMA = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("similarity", T.DoubleType())]
)


def _query_passes(queries: DataFrame, max_broadcast_bytes: int):
    """Plan passes over the query table whose matrices fit the broadcast bound.

    Returns ``(dims, n_pass, fetch)``; ``fetch(p)`` collects pass ``p`` only.
    Passes are hash slices of ``query_id``; every slice is counted and a slice
    over the bound is split again with another hash seed, so each collected
    matrix is proven to hold at most ``max_broadcast_bytes`` of vectors.
    """
    n_q, n_ids = queries.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n_q == 0:
        return 0, 0, None
    if n_q != n_ids:
        raise ValueError("query_id values must be unique and not null")
    dims = queries.agg(F.max(F.size("query"))).first()[0]
    dims = max(dims or 0, 0)  # -1: all are null
    per_pass = max(1, max_broadcast_bytes // (8 * max(dims, 1)))
    preds: list = []

    def split(pred, n: int, depth: int) -> None:
        if n <= per_pass:
            preds.append(pred)
            return
        parts = math.ceil(2 * n / per_pass)
        for p in range(parts):
            sub = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(parts)) == p
            cond = sub if pred is None else pred & sub
            c = queries.where(cond).count()
            if c:
                split(cond, c, depth + 1)

    split(None, n_q, 0)

    def fetch(p: int):
        qpart = queries if preds[p] is None else queries.where(preds[p])
        rows = qpart.select("query_id", "query").collect()  # at most per_pass rows, counted above
        if not rows:
            return None
        # a null query, or one of another width, is zero: it has null similarities
        fit = [r["query"] if r["query"] is not None and len(r["query"]) == dims else [0.0] * dims for r in rows]
        return np.array([r["query_id"] for r in rows], np.int64), np.array(fit, np.float64).reshape(len(rows), dims)

    return dims, len(preds), fetch


def _run_passes(spark: SparkSession, n_pass: int, fetch, build, k: int) -> DataFrame | None:
    """Top-k of all queries. One pass stays a lazy plan; of several, each is merged and
    written to the shared folder before the next is fetched, so the driver holds the
    queries of one pass only and the result is one scan. ``build(qids, qmat, share)`` sends
    what its tasks need by ``share``, which is destroyed after the pass."""
    if n_pass == 0:
        return None
    share = spark.sparkContext.broadcast
    if n_pass == 1:
        return _merge_topk(build(*fetch(0), share), k)
    root = shared_dir(spark, "knn")
    for p in range(n_pass):
        sent: list = []

        def kept(value):
            sent.append(share(value))
            return sent[-1]

        _merge_topk(build(*fetch(p), kept), k).write.mode("append").parquet(root)
        for b in sent:
            b.destroy()
    return spark.read.parquet(root)


def _merge_topk(local: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), F.asc("id"))
    return (
        local.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "similarity")
    )


# Queries and chunks in one block of the kNN join, and blocks of chunks at least.
QUERY_BLOCK, CHUNK_BLOCK, SPREAD = 1024, 8192, 32
TILE_ROWS = 2048  # rows scored at once: 16 MB of similarities
MANY_BLOCK, TILE_QUERIES = 4096, 1024  # with as many queries as chunks: queries in one block, and scored at once
FIRST_ROWS = 512  # rows from which a query's first threshold comes
EXACT_PAIRS = 1 << 15  # pairs scored in doubles at once
MERGED = 64  # blocks whose results meet in the first of two merges


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; a null vector, or one of another width, is zero (its
    similarity is null), a null component is nan."""
    lists = column.combine_chunks().cast(pa.large_list(pa.float64()))
    off, out = lists.offsets.to_numpy(), np.zeros((len(lists), dims))
    fit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(off) == dims))
    if dims and len(fit):
        out[fit] = lists.values.to_numpy(zero_copy_only=False)[off[fit][:, None] + np.arange(dims)]
    return out


def exact_cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows, each summed by itself: equal vectors have equal ones wherever they stand."""
    out = np.empty(len(x))
    for at in range(0, len(x), EXACT_PAIRS):
        a, b = x[at : at + EXACT_PAIRS], q[at : at + EXACT_PAIRS]
        out[at : at + EXACT_PAIRS] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return out


def directed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors as floats)."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((x * x).sum(1))
    ok = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return ok, (x[ok] / norms[ok, None]).astype(np.float32)


def places_in_groups(groups: np.ndarray) -> np.ndarray:
    """The place of each entry within its group, of a sorted array."""
    new = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(new, np.diff(np.r_[new, len(groups)]))


def _least_of_equals(x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of rows with the same vector the ``k`` least by ``order``: no other can be among the best k."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    by = np.lexsort((order, same))
    return np.sort(by[places_in_groups(same[by]) < k])


class Shortlist:
    """Per query, the entries offered so far that can be among its best ``k``: those at least as good as its k-th
    best less ``margin``. Entries are compared when some have gathered, so a threshold may lag behind."""

    def __init__(self, n_queries: int, k: int, margin: float):
        self.k, self.margin, self.pending = k, margin, 0
        self.least = np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, row, score))
        self.pending += len(query)
        if self.pending > 2 * self.k * len(self.least):
            self.entries()

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of what stays, by query, falling score and row."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, row, score = (np.concatenate(x) for x in zip(*self.parts))
        by = np.lexsort((row, -score, query))
        query, row, score = query[by], row[by], score[by]
        kth = places_in_groups(query) == self.k - 1
        self.least[query[kth]] = score[kth] - self.margin
        stay = score >= self.least[query]
        self.parts, self.pending = [(query[stay], row[stay], score[stay])], 0
        return self.parts[0]


def _best_pairs(x: np.ndarray, order: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, cosine) of the k best rows of each query, ties by ``order``, null cosines (nan) last, for some
    queries at a time. Each product of float unit vectors is within ``(dims + 4) / 2^24`` of the true cosine, so the best
    k are among the rows whose product is at most four such errors below the k-th greatest."""
    ok, unit = directed(x)
    kept = _least_of_equals(x[ok], order[ok], k) if len(ok) else ok
    rows, unit = ok[kept], unit[kept]
    asked, aim = directed(q)
    bare = np.setdiff1d(np.arange(len(x)), ok)
    bare = bare[np.argsort(order[bare], kind="stable")][: max(0, k - len(ok))]  # rows without direction, where others are too few
    for at in range(0, len(asked), TILE_QUERIES):
        mine = aim[at : at + TILE_QUERIES]
        short = Shortlist(len(mine), k, 4 * (x.shape[1] + 4) * 2.0**-24)
        edges = [0, *range(min(FIRST_ROWS, len(rows)), len(rows), TILE_ROWS), len(rows)] if len(rows) else [0]
        for lo, hi in zip(edges, edges[1:]):
            score = mine @ unit[lo:hi].T
            if not lo and hi > k:
                short.least = np.partition(score, hi - k, axis=1)[:, hi - k].astype(np.float64) - short.margin
            query, row = np.nonzero(score >= short.least.astype(np.float32)[:, None] - np.float32(2.0**-23))
            short.offer(query, row + lo, score[query, row].astype(np.float64))
        query, row, _ = short.entries()
        cosine = np.empty(len(query))
        for lo in range(0, len(query), EXACT_PAIRS):
            some = slice(lo, lo + EXACT_PAIRS)
            cosine[some] = exact_cosine(x[rows[row[some]]], q[asked[at + query[some]]])
        by = np.lexsort((order[rows[row]], -cosine, query))
        by = by[places_in_groups(query[by]) < k]
        yield asked[at + query[by]], rows[row[by]], cosine[by]
        yield np.repeat(asked[at : at + TILE_QUERIES], len(bare)), np.tile(bare, len(mine)), np.full(len(mine) * len(bare), np.nan)
    lost = np.setdiff1d(np.arange(len(q)), asked)
    first = np.argsort(order, kind="stable")[:k]
    yield np.repeat(lost, len(first)), np.tile(first, len(lost)), np.full(len(lost) * len(first), np.nan)


def _knn_block(k: int):
    """cogroup body: the exact top-k of a block of queries within a block of chunks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            qids, ids, p = left["query_id"].to_numpy(), right["id"].to_numpy(), right["p"][0].as_py()
            widths = np.array([0 if q is None else len(q) for q in left["query"].to_pylist()])
            for dims in np.unique(widths):
                mine = np.flatnonzero(widths == dims)
                qmat, x = _matrix(left["query"].take(pa.array(mine)), int(dims)), _matrix(right["embedding"], int(dims))
                best = _DenseTopK(len(mine), k)
                for at in range(0, len(ids), TILE_ROWS):
                    best.offer_all(ids[at : at + TILE_ROWS], _cosine(x[at : at + TILE_ROWS], qmat))
                out = best.batch(qids[mine])
                parts.append(pa.Table.from_batches([out]).append_column("part", pa.array(np.full(out.num_rows, p // MERGED))))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("part", pa.int64()))})

    return run


def _many_block(k: int):
    """cogroup body: as ``_knn_block``, for many queries, with equal similarities for equal vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            p, order = right["p"][0].as_py(), pc.fill_null(right["id"], np.iinfo(np.int64).min).to_numpy()
            widths = pc.fill_null(pc.list_value_length(left["query"]), 0).to_numpy()
            for dims in np.unique(widths):
                mine = np.flatnonzero(widths == dims)
                qmat, x = _matrix(left["query"].take(pa.array(mine)), int(dims)), _matrix(right["embedding"], int(dims))
                for query, row, cosine in _best_pairs(x, order, qmat, k):
                    columns = [left["query_id"].take(pa.array(mine[query])), right["id"].take(pa.array(row)), pa.array(cosine, pa.float64(), from_pandas=True)]
                    parts.append(pa.table([*columns, pa.array(np.full(len(query), p // MERGED))], names=["query_id", "id", "similarity", "part"]))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("part", pa.int64()))})

    return run


def blocks_joined(left: DataFrame, left_key: str, n_left: int, left_block: int, right: DataFrame, right_key: str, n_right: int, right_block: int, spread: int, run, schema) -> DataFrame:
    """Every block of ``left`` meets every block of ``right`` as one cogrouped task (columns p and q
    name the blocks). Rows are dealt by the hash of their keys, so blocks are alike in size whatever
    the data; a row is repeated once for each block of the other side, and no pair becomes a row."""
    lefts, rights = max(1, -(-n_left // left_block)), max(spread, -(-n_right // right_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    a = left.withColumn("q", dealt(left_key, lefts)).withColumn("p", every(rights))
    b = right.withColumn("p", dealt(right_key, rights)).withColumn("q", every(lefts))
    return a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(run, schema)


def checked_queries(queries: DataFrame) -> int:
    """How many queries there are; their ids must be unique and not null."""
    n, ids = queries.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n != ids:
        raise ValueError("query_id values must be unique and not null")
    return n


def search_batch(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, query_block: int | None = None, chunk_block: int = CHUNK_BLOCK, many: bool = False) -> DataFrame:
    """Exact top-k for every row of ``queries(query_id, query)``: (query_id, rank, id, similarity).

    A block join in Spark: queries and chunks are dealt into blocks, each pair of blocks is one matrix product
    with a running top-k, and k rows a query and block are merged in two levels. Nothing passes through the
    driver and nothing is broadcast. A null query or chunk vector, a zero one, and a pair of different widths have a
    null similarity and come last, by id. Repeated query ids are refused.

    ``many`` is for as many queries as chunks: larger blocks of queries, a cheaper choice of pairs, and each chosen pair
    scored by itself, so equal vectors tie by id. Rows of one query id are then one query: the k best of all their pairs."""
    if k <= 0:
        raise ValueError("top_k must be greater than 0.")
    query = F.col("query") if many else F.col("query").cast("array<double>")
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), query.alias("query"))
    right = chunks.select(F.col("id").cast("long").alias("id"), "embedding")
    schema = "query_id long, id long, similarity double, part long"
    query_block = query_block or (MANY_BLOCK if many else QUERY_BLOCK)
    n = left.count() if many else checked_queries(left)
    spread = -(-SPREAD // max(1, -(-n // query_block))) if many else SPREAD
    found = blocks_joined(left, "query_id", n, query_block, right, "id", right.count(), chunk_block, spread, (_many_block if many else _knn_block)(k), schema)
    order = [F.desc_nulls_last("similarity"), F.asc("id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return _merge_topk(first, k)


# Q6
@F.pandas_udf(T.StringType())
def shortened(text: pd.Series) -> pd.Series:
    """White space collapsed; over 340 characters cut after a whole word, or a hyphen
    within one, and marked (the standard library's rule)."""
    return text.map(lambda t: None if t is None else textwrap.shorten(t, PREVIEW_WIDTH, placeholder=PREVIEW_PLACEHOLDER))


def rank_results(results: DataFrame, full: bool = False, most: int = MOST_RANKED) -> DataFrame:
    """Rank (1-based), similarity to 4 places, word-cut preview, minute timestamp.

    ``results`` is a top-k of at most ``most`` rows, so that the rank is a row number over
    one small partition; a longer result is refused when it runs.
    """
    order = [F.desc_nulls_last("similarity"), F.asc("id")]
    collapsed = F.btrim(F.regexp_replace(F.col("chunk_text"), WS + "+", " "))
    rank = F.row_number().over(Window.orderBy(*order))
    fits = F.when(rank <= most, rank).otherwise(F.raise_error(F.lit(f"rank_results takes at most {most} rows.")))
    return results.orderBy(*order).limit(most + 1).select(
        fits.cast("int").alias("rank"),
        F.format_number(F.col("similarity"), 4).alias("similarity_text"),
        "id",
        "filename",
        "split_strategy",
        "chunk_index",
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_text"),
        (collapsed if full else shortened("chunk_text")).alias("preview"),
    )


# Q7
def diagnose_empty(
    chunks: DataFrame, filename: str | None = None, split_strategy: str | None = None
) -> DataFrame:
    """One pass: total rows, matching rows and the message a user should see."""
    cond = F.lit(True)
    active = []
    if filename is not None:
        cond = cond & (F.col("filename") == filename)
        active.append(f"filename={filename}")
    if split_strategy is not None:
        cond = cond & (F.col("split_strategy") == split_strategy)
        active.append(f"strategy={split_strategy}")
    suffix = f" matching {', '.join(active)}" if active else ""
    agg = chunks.agg(F.count(F.lit(1)).alias("total_indexed"), F.count_if(cond).alias("matched"))
    message = (
        F.when(F.col("matched") > 0, F.lit("ok"))
        .when(F.col("total_indexed") == 0, F.lit("No results: the index is empty."))
        .otherwise(
            F.concat(
                F.lit(f"No results{suffix}. The index holds "),
                F.format_number(F.col("total_indexed"), 0),
                F.lit(" chunks -- try a broader query or remove the filters."),
            )
        )
    )
    return agg.withColumn("message", message)


# Q8
def index_summary(chunks: DataFrame) -> DataFrame:
    """Per file and strategy: chunk count, vector width range, first preview."""
    return chunks.groupBy("filename", "split_strategy").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(F.size("embedding")).alias("min_dims"),
        F.max(F.size("embedding")).alias("max_dims"),
        F.min_by(F.left(F.col("chunk_text"), F.lit(42)), F.struct("chunk_index", "id")).alias("first_preview"),
    )


# Q5
MIN_CELLS, MAX_CELLS = 16, 65_536


def cells_for(n: int) -> int:
    """The square root of the number of vectors: cells and their size grow alike."""
    return min(MAX_CELLS, max(MIN_CELLS, math.isqrt(n)))


def build_ivf(chunks: DataFrame, n_cells: int | None = None, seed: int = 7, max_iter: int = 20,
              train_fraction: float | None = None, train_rows: int = 65_536):
    """Train IVF cells (``cells_for`` the rows unless given) with ``pyspark.ml``
    KMeans on unit vectors.

    The centroids are trained on at most ``train_rows`` chunks, those whose ids hash
    least (and of those on ``train_fraction``); every chunk is assigned to a cell and search
    scores every chunk of the probed cells, so no result row is dropped.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = chunks.count()
    n_cells = n_cells or cells_for(total)
    if total > train_rows:
        chunks = chunks.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    unit = chunks.select(array_to_vector(V.l2_normalize("embedding")).alias("features")).where(
        F.col("features").isNotNull()
    )
    if train_fraction is not None and 0 < train_fraction < 1:
        unit = unit.sample(fraction=train_fraction, seed=seed)
    return KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell").fit(unit)


def _ivf_partition(shared, k: int, dims: int):
    """mapInArrow body: score each chunk only against the queries probing its
    cell; one dense running top-k per cell (k rows per query and cell leave
    the task, at most n_probe x k per query). ``shared`` is the broadcast (ids, matrix,
    queries by cell) of one pass."""

    def run(batches: Iterable[pa.RecordBatch]):
        qids, qmat, probes = shared.value
        per_cell: dict[int, _DenseTopK] = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = rb.column(2).to_numpy(zero_copy_only=False)
            x = _vectors(rb, 1, dims)
            for cell in np.unique(cells):
                qs = probes.get(int(cell))
                if qs is None:
                    continue
                rows = np.nonzero(cells == cell)[0]
                best = per_cell.setdefault(int(cell), _DenseTopK(len(qs), k))
                best.offer_all(ids[rows], _cosine(x[rows], qmat[qs]))
        for cell, best in per_cell.items():
            out = best.batch(qids[probes[cell]])
            if out is not None:
                yield out

    return run


def search_approx(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    n_cells: int | None = None,
    n_probe: int = 4,
    model=None,
    max_broadcast_bytes: int = MAX_QUERY_BROADCAST_BYTES,
) -> DataFrame:
    """IVF approximate top-k: each query is scored only against its ``n_probe``
    nearest cells. Cell ids are assigned natively by the KMeans model; the
    scoring is the same bounded-output numpy kernel as ``search_batch``.
    """
    from pyspark.ml.functions import array_to_vector

    if k <= 0:
        raise ValueError("top_k must be greater than 0.")
    model = model or build_ivf(chunks, n_cells=n_cells)
    centers = np.array(model.clusterCenters(), np.float64)  # n_cells x dims
    dims, n_pass, fetch = _query_passes(queries, max_broadcast_bytes)
    celled = model.transform(
        chunks.select(F.col("id").cast("long").alias("id"), "embedding").withColumn(
            "features", array_to_vector(V.l2_normalize("embedding"))
        ).where(F.col("features").isNotNull())
    ).select("id", "embedding", F.col("cell").cast("int").alias("cell"))

    def build(qids, qmat, share):
        near = np.argsort(-_cosine(qmat, centers), axis=1)[:, : min(n_probe, len(centers))]
        probes: dict[int, list[int]] = {}
        for j, cells in enumerate(near):
            for c in cells:
                probes.setdefault(int(c), []).append(j)
        probes = {c: np.array(v, np.int64) for c, v in probes.items()}
        return celled.mapInArrow(_ivf_partition(share((qids, qmat, probes)), k, dims), KNN_SCHEMA)

    spark = chunks.sparkSession
    found = _run_passes(spark, n_pass, fetch, build, k)
    return spark.createDataFrame([], "query_id long, rank int, id long, similarity double") if found is None else found


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Fraction of exact hits the approximate search returned, per query."""
    hit = exact.alias("e").join(approx.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.col("found").isNotNull().cast("double")).alias("recall"))


# Q5, stored form: chunks partitioned by IVF cell, searches read probed cells only
def write_ivf_index(chunks: DataFrame, model, root: str) -> None:
    """Persist the KMeans model and the chunk vectors partitioned by cell."""
    from pyspark.ml.functions import array_to_vector

    model.write().overwrite().save(f"{root}/model")
    celled = model.transform(
        chunks.select(F.col("id").cast("long").alias("id"), "embedding").withColumn(
            "features", array_to_vector(V.l2_normalize("embedding"))
        ).where(F.col("features").isNotNull())
    ).select("id", "embedding", F.col("cell").cast("int").alias("cell"))
    # rebalanced, so that AQE writes a large cell by many tasks
    celled.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/vectors")


def search_ivf_index(spark, root: str, queries: DataFrame, k: int = DEFAULT_TOP_K, n_probe: int = 4,
                     max_broadcast_bytes: int = MAX_QUERY_BROADCAST_BYTES) -> DataFrame:
    """Approximate top-k over a stored IVF index: each pass reads only the
    cell partitions its queries probe (a partition filter on ``cell``)."""
    from pyspark.ml.clustering import KMeansModel

    if k <= 0:
        raise ValueError("top_k must be greater than 0.")
    model = KMeansModel.load(f"{root}/model")
    centers = np.array(model.clusterCenters(), np.float64)
    stored = spark.read.parquet(f"{root}/vectors")
    dims, n_pass, fetch = _query_passes(queries, max_broadcast_bytes)

    def build(qids, qmat, share):
        near = np.argsort(-_cosine(qmat, centers), axis=1)[:, : min(n_probe, len(centers))]
        probes: dict[int, list[int]] = {}
        for j, cells in enumerate(near):
            for c in cells:
                probes.setdefault(int(c), []).append(j)
        probes = {c: np.array(v, np.int64) for c, v in probes.items()}
        wanted = stored.where(F.col("cell").isin(sorted(probes))).select("id", "embedding", "cell")
        return wanted.mapInArrow(_ivf_partition(share((qids, qmat, probes)), k, dims), KNN_SCHEMA)

    found = _run_passes(spark, n_pass, fetch, build, k)
    return spark.createDataFrame([], "query_id long, rank int, id long, similarity double") if found is None else found
