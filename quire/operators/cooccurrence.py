"""An embedding learnt from the corpus, offline.

1. The vocabulary: the ``size`` words that stand in the most documents (a bounded parameter).
2. Co-occurrence: for every two vocabulary words at most ``window`` words apart, how often; counted over
   all whole texts, each task summing its own pairs before the shuffle.
3. Positive pointwise mutual information of each pair: what the pair occurs more than chance, as a logarithm.
4. The leading eigenvectors of that symmetric matrix by block power iteration: the matrix stays in Spark, one row
   a word; each round sends the block (size x dims doubles) to the tasks, which return its products with their rows.
   Orthonormalising and the last rotation (size x dims again) are the driver's. Components come in falling order
   of eigenvalue, so that ``truncate_dims`` keeps the leading ones.
5. A text's vector is the sum of its words', so it can be compared with any text's.

Defined results: texts without a vocabulary word have a zero vector, which ``embed_texts`` reports as a failure.
Ties in the vocabulary go by the word. Words are lower-cased runs of letters and digits, as the hashed provider's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.chunking import text_slices
from quire.operators.embedding import TOKEN_SPLIT, HashingProvider
from quire.session import shared_dir

SIZE, MIN_DOCS, WINDOW = 4096, 3, 4
DIMS, EXTRA, ROUNDS, TOLERANCE = 64, 16, 40, 1e-4


def vocabulary(docs: DataFrame, text_col: str, size: int = SIZE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(word, n_docs) of the ``size`` words in the most documents."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT, -1))
    seen = docs.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    return seen.where(F.col("n_docs") >= min_docs).orderBy(F.desc("n_docs"), "word").limit(size)


class _Pairs:
    """Sums of co-occurring word numbers, given away when many have gathered."""

    def __init__(self, n: int, most: int = 1 << 21):
        self.n, self.most, self.held, self.size = n, most, [], 0

    def add(self, ids: np.ndarray, window: int) -> None:
        for k in range(1, window + 1):
            a, b = ids[:-k], ids[k:]
            both = (a >= 0) & (b >= 0)
            lo, hi = np.minimum(a[both], b[both]), np.maximum(a[both], b[both])
            self.held.append(lo * self.n + hi)
            self.size += len(lo)

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size > least:
            key, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(key // self.n), pa.array(key % self.n), pa.array(n)], names=["i", "j", "n"])


def pair_counts(docs: DataFrame, text_col: str, words: list[str], window: int = WINDOW) -> DataFrame:
    """(i, j, n): how often words number i <= j of ``words`` stand at most ``window`` words apart."""
    share = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(share.value)}
        tokens, pairs, gap = HashingProvider().tokens, _Pairs(len(number)), [-1] * window  # between two texts
        for some in text_slices(batches, 0):
            ids: list[int] = []
            for text in some.column(0).to_pylist():
                ids += [number.get(t, -1) for t in tokens(text)]
                ids += gap
            pairs.add(np.array(ids, np.int64), window)
            yield from pairs.taken(pairs.most)
        yield from pairs.taken()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "i long, j long, n long")
    return counted.groupBy("i", "j").agg(F.sum("n").alias("n"))


def ppmi(counts: DataFrame) -> DataFrame:
    """(i, j, n, value) of the pairs that occur more than chance. The matrix is symmetric: a pair of two
    words counts in both their rows, one of a word with itself twice in its own."""
    spark, path = counts.sparkSession, shared_dir(counts.sparkSession, "pair-counts")
    counts.write.parquet(path)  # read twice below: texts are counted once
    counts = spark.read.schema("i long, j long, n long").parquet(path)
    share = F.explode(F.array(F.struct(F.col("i").alias("k"), "n"), F.struct(F.col("j").alias("k"), "n")))
    sums = counts.select(share.alias("x")).groupBy("x.k").agg(F.sum("x.n").alias("s"))
    total = sums.agg(F.sum("s").alias("total"))
    side = lambda c: sums.select(F.col("k").alias(c), F.col("s").cast("double").alias(f"s{c}"))
    rows = counts.join(side("i"), "i").join(side("j"), "j").join(F.broadcast(total))  # one row
    times = F.col("n") * F.when(F.col("i") == F.col("j"), 2).otherwise(1)
    value = F.log(times * F.col("total") / (F.col("si") * F.col("sj")))
    return rows.select("i", "j", "n", value.alias("value")).where("value > 0")


def leading(matrix: DataFrame, n: int, dims: int, extra: int = EXTRA, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, n x dims eigenvectors) of largest magnitude of the symmetric matrix (i, j, value), i <= j."""
    spark = matrix.sparkSession
    both = matrix.select("i", "j", "value").unionByName(matrix.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    path = shared_dir(spark, "ppmi-rows")
    # a word's row has at most n entries
    both.groupBy("i").agg(F.collect_list("j").alias("js"), F.collect_list("value").alias("vs")).write.parquet(path)
    rows = spark.read.parquet(path)
    width = min(n, dims + extra)

    def product(block: np.ndarray) -> np.ndarray:
        share = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [(v.values.to_numpy() @ share.value[j.values.to_numpy()]).tolist() for j, v in zip(b.column(1), b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float64()))], names=["i", "x"])

        out = np.zeros_like(block)
        got = rows.mapInArrow(run, "i long, x array<double>").toArrow()
        if got.num_rows:
            out[got["i"].to_numpy()] = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        share.destroy()
        return out

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    last = None
    for _ in range(rounds):
        made = product(block)
        small = block.T @ made
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:dims]
        now, found = values[order], block @ turn[:, order]
        if last is not None and np.abs(now - last).max(initial=0) <= tolerance * max(np.abs(now).max(initial=0), 1e-12):
            break
        last, block = now, np.linalg.qr(made)[0]
    # a component's sign is free: its largest entry is positive
    signs = np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])]) if n else np.ones(0)
    return now, found * np.where(signs == 0, 1, signs)


class CooccurrenceProvider:
    """Learnt word vectors as an embedding provider; ``task_type`` does not change the vector."""

    def __init__(self, words: list[str], vectors: np.ndarray):
        self.number = {w: k for k, w in enumerate(words)}
        self.vectors, self.dims = vectors, vectors.shape[1]
        digest = hashlib.sha256("\n".join(words).encode() + np.round(vectors, 6).tobytes()).hexdigest()[:12]
        self.name = f"cooccurrence-{digest}-{self.dims}"
        self._tokens = HashingProvider().tokens

    def embed(self, texts: list[str], task_type: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            ids = [k for k in map(self.number.get, self._tokens(text)) if k is not None]
            if ids:
                out[i] = np.bincount(ids, minlength=len(self.number)) @ self.vectors
        return out


def learnt_provider(docs: DataFrame, text_col: str = "text", size: int = SIZE, min_docs: int = MIN_DOCS, window: int = WINDOW, dims: int = DIMS) -> CooccurrenceProvider:
    """A provider of ``dims`` components learnt on all texts of ``docs``; a word's vector is its row of the
    eigenvectors, each scaled by the root of its eigenvalue."""
    words = [r["word"] for r in vocabulary(docs, text_col, size, min_docs).collect()]
    if not words:
        return CooccurrenceProvider([], np.zeros((0, dims)))
    values, found = leading(ppmi(pair_counts(docs, text_col, words, window)), len(words), dims)
    vectors = np.zeros((len(words), dims))
    vectors[:, : found.shape[1]] = found * np.sqrt(np.abs(values))
    return CooccurrenceProvider(words, vectors)
