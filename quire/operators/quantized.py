"""Q5: an approximate index by product quantisation.

* Cells: ``pyspark.ml`` KMeans on a bounded sample (TRAIN_ROWS unit vectors whose ids hash least).
* Codes: a vector less its cell's centre is cut into PARTS stretches; each is coded by one byte, the nearest
  of up to WORDS codewords, which one Spark task a stretch learns on the same sample. Every row is coded.
* Search: blocks of queries meet blocks of codes (``retrieval.blocks_joined``). The score of a code is the
  query's product with the cell's centre plus one table entry a stretch, for the ``n_probe`` cells whose
  centres have the highest products (all cells unless given). The CANDIDATES best codes of a query are
  scored again by their full vectors, and the best k stay: a query goes once to each block of vectors that
  holds some of its candidates, with their ids.

A query thus reads one code (PARTS bytes) a row and CANDIDATES full vectors.

Defined results: chunks without a direction (null or zero vector, null or non-finite components, another width
than most) are not indexed and never found; a query of that kind finds nothing. Ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import vectors as V
from quire.operators import retrieval as R
from quire.session import shared_dir

TRAIN_ROWS = 20_000
PARTS = 16
WORDS = 256
ROUNDS = 12
CANDIDATES = 100
TILE = 256  # queries scored at once
QUERY_BLOCK, SPREAD = 1024, 16  # queries in one block, pairs of blocks at least
CODE_BLOCK = 1 << 18  # codes in one block: each block gives CANDIDATES rows a query, so it is large (7 MB)
FULL_QUERIES = 8192  # queries in one block where full vectors are scored


@dataclass
class Quantizer:
    """Centres of the cells and, by stretch, codewords of residuals (widths padded to PARTS stretches)."""

    dims: int
    centers: np.ndarray
    books: np.ndarray  # PARTS x words x width

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * self.books.shape[2] - x.shape[1])))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit vectors."""
        cell = np.concatenate([_nearest(x[at : at + 256], self.centers) for at in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.int64)
        rest = self.padded(x - self.centers[cell]).reshape(len(x), *self.books.shape[::2])
        return cell, np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def _units(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction in ``dims`` dimensions, their unit vectors)."""
    x = R._matrix(column, dims)
    top = np.abs(x).max(1, initial=0)
    ok = np.flatnonzero(np.isfinite(top) & (top > 0))
    x = x[ok] / top[ok, None]
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def _learnt(table: pa.Table, words: int) -> pa.Table:
    """Codewords of one stretch by Lloyd's rounds, begun at rows spread over the sample."""
    part = table["part"][0].as_py()
    x = table.sort_by("id")["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    book = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        mine = _nearest(x, book)
        n = np.bincount(mine, minlength=len(book))
        sums = np.stack([np.bincount(mine, x[:, j], len(book)) for j in range(x.shape[1])], 1)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return pa.table({"part": pa.array([part], pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})


def fit(chunks: DataFrame, n_cells: int | None = None, parts: int = PARTS, words: int = WORDS, train_rows: int = TRAIN_ROWS, seed: int = 7) -> Quantizer:
    """Learn cells and codewords on at most ``train_rows`` vectors of the commonest width."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = chunks.sparkSession
    rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return Quantizer(0, np.zeros((0, 0)), np.zeros((parts, 1, 0)))
    dims, total = width["d"], width["count"]
    path = shared_dir(spark, "quantizer-sample")
    some = rows.where(F.size("v") == dims).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    unit = some.select("id", V.l2_normalize("v").cast("array<double>").alias("v")).where("v is not null and forall(v, x -> x is not null and abs(x) <= 1)")
    unit.write.parquet(path)
    sample = spark.read.schema("id long, v array<double>").parquet(path)
    n = sample.count()
    if not n:
        return Quantizer(dims, np.zeros((0, dims)), np.zeros((parts, 1, -(-dims // parts))))
    cells = min(n_cells or R.cells_for(total), n)
    features = sample.select(array_to_vector("v").alias("features"))
    centers = np.array(KMeans(k=max(2, cells), seed=seed, maxIter=ROUNDS).fit(features).clusterCenters()) if cells > 1 else np.zeros((1, dims))
    width_of, share = -(-dims // parts), spark.sparkContext.broadcast(centers)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = R._matrix(pa.chunked_array([b.column(1)]), dims)
            x = np.pad(x - share.value[_nearest(x, share.value)], ((0, 0), (0, parts * width_of - dims))).reshape(len(x), parts, width_of)
            for m in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), m, np.int32)), b.column(0), pa.array(list(x[:, m]), pa.list_(pa.float64()))], names=["part", "id", "x"])

    learnt = sample.mapInArrow(cut, "part int, id long, x array<double>").groupBy("part").applyInArrow(lambda t: _learnt(t, words), "part int, book array<double>")
    books = [np.array(r["book"]).reshape(-1, width_of) for r in learnt.orderBy("part").collect()]
    return Quantizer(dims, centers, np.stack(books))


def write_index(chunks: DataFrame, index: Quantizer, root: str) -> None:
    """Codes (id, cell, code) and full vectors (id, embedding) of every chunk that has a direction."""
    share = chunks.sparkSession.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, R.TILE_ROWS):
                b = whole.slice(at, R.TILE_ROWS)
                ok, x = _units(pa.chunked_array([b.column(1)]), share.value.dims)
                cell, codes = share.value.coded(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    rows = chunks.select(F.col("id").cast("long").alias("id"), "embedding")
    codes = rows.where("id is not null").mapInArrow(code, "id long, cell int, code binary") if len(index.centers) else chunks.sparkSession.createDataFrame([], "id long, cell int, code binary")
    codes.write.parquet(f"{root}/codes")
    rows.write.parquet(f"{root}/vectors")


def _looked_up(index, k: int):
    """cogroup body: for a block of queries, the ids of its best codes in one block, with their scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            z = index.value
            right = right.combine_chunks().sort_by("id")
            ids, code = right["id"].to_numpy(), np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(right), -1)
            cells, cell = np.unique(right["cell"].to_numpy(), return_inverse=True)
            qids, unit = left["query_id"].to_numpy(), R._matrix(left["unit"], z.dims)
            floor = left["floor"].to_numpy()
            for at in range(0, len(qids), TILE):
                q = unit[at : at + TILE]
                base = z.centers[cells] @ q.T
                base[base < floor[None, at : at + TILE]] = -np.inf
                cut = z.padded(q).reshape(len(q), *z.books.shape[::2])
                tables = [np.ascontiguousarray(book @ cut[:, m].T) for m, book in enumerate(z.books)]  # words x queries
                # ids ascend, so the place of a row settles ties
                short = R.Shortlist(len(q), k, 0.0)
                for lo in range(0, len(ids), R.TILE_ROWS):
                    score = base[cell[lo : lo + R.TILE_ROWS]]
                    for m, table in enumerate(tables):
                        score += table[code[lo : lo + R.TILE_ROWS, m]]
                    if not lo and len(score) > k:
                        short.least = np.partition(score.T, len(score) - k, axis=1)[:, len(score) - k]
                    row, query = np.nonzero((score >= short.least) & (score > -np.inf))
                    short.offer(query, row + lo, score[row, query])
                query, row, score = short.entries()
                best = R.places_in_groups(query) < k
                out["query_id"].append(qids[at : at + TILE][query[best]])
                out["id"].append(ids[row[best]])
                out["score"].append(score[best])
        kinds = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0), t, safe=False) for (c, v), t in zip(out.items(), kinds.values())})

    return run


def _scored_in_full(k: int):
    """cogroup body: the best k of each query among those of its candidates that one block of vectors holds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return out
        right = right.combine_chunks().sort_by("id")
        ids, found = right["id"].to_numpy(), []
        widths = pc.fill_null(pc.list_value_length(left["query"]), 0).to_numpy()
        for dims in np.unique(widths):
            mine = left.take(pa.array(np.flatnonzero(widths == dims)))
            x, q = R._matrix(right["embedding"], int(dims)), R._matrix(mine["query"], int(dims))
            wanted = mine["ids"].combine_chunks()
            query, want = np.repeat(np.arange(len(mine)), pc.list_value_length(wanted).to_numpy()), wanted.flatten().to_numpy()
            first, last = np.searchsorted(ids, want), np.searchsorted(ids, want, "right")  # an id may have several rows
            n = last - first
            query, row = np.repeat(query, n), np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            cosine = np.empty(len(row))
            for at in range(0, len(row), R.EXACT_PAIRS):
                some = slice(at, at + R.EXACT_PAIRS)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine[some] = R.exact_cosine(x[row[some]], q[query[some]])
            sound = np.isfinite(cosine)
            query, row, cosine = query[sound], row[sound], cosine[sound]
            by = np.lexsort((row, -cosine, query))
            by = by[R.places_in_groups(query[by]) < k]
            found.append(pa.table({"query_id": mine["query_id"].take(pa.array(query[by])), "id": ids[row[by]], "similarity": cosine[by]}))
        return pa.concat_tables(found)

    return run


def search_index(spark: SparkSession, root: str, index: Quantizer, queries: DataFrame, k: int = R.DEFAULT_TOP_K, n_probe: int | None = None, candidates: int = CANDIDATES, unique: bool = True) -> DataFrame:
    """(query_id, rank, id, similarity): the best k of each query's ``candidates`` best codes. Repeated query ids are
    refused, or with ``unique=False`` rows of one id are one query: the best k of all their pairs."""
    if k <= 0 or candidates < k:
        raise ValueError("top_k must be greater than 0 and at most the candidates.")
    share, cells = spark.sparkContext.broadcast(index), len(index.centers)
    probed = min(n_probe or cells, cells)

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                ok, x = _units(pa.chunked_array([b.column(1)]), share.value.dims)
                near = x @ share.value.centers.T
                floor = np.partition(near, cells - probed, axis=1)[:, cells - probed] if probed < cells else np.full(len(x), -np.inf)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(list(x), pa.list_(pa.float64())), pa.array(floor)], names=["query_id", "unit", "floor"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
    n = R.checked_queries(asked) if unique else asked.count()
    codes, vectors = spark.read.parquet(f"{root}/codes"), spark.read.parquet(f"{root}/vectors")
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, id long, similarity double")
    left = asked.mapInArrow(aimed, "query_id long, unit array<double>, floor double")
    spread = -(-SPREAD // max(1, -(-n // QUERY_BLOCK)))
    found = R.blocks_joined(left, "query_id", n, QUERY_BLOCK, codes, "id", codes.count(), CODE_BLOCK, spread, _looked_up(share, candidates), "query_id long, id long, score double")
    # equal pairs of repeated rows are one candidate
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= candidates)
    ps, qs = max(SPREAD, -(-vectors.count() // R.CHUNK_BLOCK)), max(1, -(-n // FULL_QUERIES))
    block = F.pmod(F.xxhash64("id"), F.lit(ps)).cast("int").alias("p")
    sent = best.groupBy("query_id", block).agg(F.collect_set("id").alias("ids")).join(asked, "query_id")
    sent = sent.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int"))
    full = vectors.where("id is not null").select("id", "embedding", block).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    scored = sent.groupBy("p", "q").cogroup(full.groupBy("p", "q")).applyInArrow(_scored_in_full(k), "query_id long, id long, similarity double")
    return R._merge_topk(scored, k)
