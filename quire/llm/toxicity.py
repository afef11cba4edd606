"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``: the pair term
learns interactions, such as an insult with a group mention, which linear weights
miss. Terms are a document's distinct words, the first 4 and 5 bytes of its longer
words (word families) and its pairs of neighbouring words, hashed into 2^18 buckets.
Labelled training rows choose the buckets that go on: document counts by label in one
aggregation, then chi-square values of MIN_CHI and over, the MAX_TERMS largest (of at
least MIN_DOCS documents). Beside these go the words of telling pairs, whatever they tell
alone: over all pairs of a document's words, label less what the two marginal rates
together foretell is summed in hashed tables, one of 2^PAIR_BITS for each of PAIR_PARTS tasks; the HOT_CELLS largest
cells of MIN_CHI and over are counted pair by pair, and again MIN_CHI decides. The pairs of a
text are shared by those tasks and worked on PAIR_BLOCK at a time, from rows of some PAIR_WORDS words, so neither
long texts nor full Arrow batches fill a worker's memory. The machine is fitted by ``pyspark.ml.classification.FMClassifier`` on at most
TRAIN_ROWS labelled rows (those whose doc_id hashes least: a documented bound); all
whole texts are scored with the model, whose size MAX_TERMS bounds.

Defined results: null and empty texts have no terms and get the score of the intercept; a
label that is null is no label; without labels of both kinds every score is that kind
(0 if there are none). Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, col, lean, need, own, staged
from quire.llm.words import U, Words, mix, portions

BITS = 18
MAX_TERMS = 4096
MIN_DOCS = 3
MIN_CHI = 30.0  # one bucket in 10^7 passes by chance, of 2^18
TRAIN_ROWS = 20_000
TRAIN_PARTS = 8  # of the bounded sample: each iteration is so many tasks
PAIR_PARTS = 16  # tasks that share the pairs, by their first words
PAIR_BITS = 17  # cells of each: 2^21 in all
PAIR_BLOCK = 1 << 18  # pairs worked on at once
PAIR_WORDS = 1 << 16  # words of the rows whose pairs are made
HOT_CELLS = 4096
FACTORS = 4
ITERATIONS = 120
STEP = 0.05
REG = 1e-3
HEADS = (4, 5)
FOLD = 5


@dataclass
class Machine:
    """w0, and by chosen bucket the linear weight and the factors."""

    buckets: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows from their (row, bucket) pairs, sorted by row."""
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        row, at = row[hit], at[hit]
        z = self.intercept + np.bincount(row, self.linear[at], n) if len(at) else np.full(n, self.intercept)
        for f in range(self.factors.shape[1] if len(at) else 0):
            v = self.factors[at, f]
            z = z + 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def terms(column: pa.Array, bits: int = BITS, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a portion, sorted; with ``words``, of whole words only."""
    w = Words(column, HEADS)
    rows, size = w.rows(), w.ends - w.starts
    keys, owners = [w.hashes], [rows]
    if words:
        key = np.unique(rows.astype(np.int64) << bits | (w.hashes >> U(64 - bits)).astype(np.int64))
        return key >> bits, key & ((1 << bits) - 1)
    for n, h in zip(HEADS, w.heads, strict=True):
        long = size > n
        keys.append(h[long])
        owners.append(rows[long])
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        keys.append(mix(w.hashes[:-1] * U(0x9E3779B97F4A7C15) + w.hashes[1:])[same])
        owners.append(rows[:-1][same])
    key = np.concatenate(owners).astype(np.int64) << bits | (np.concatenate(keys) >> U(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)


def featurized(rows: DataFrame) -> DataFrame:
    """(id, label, buckets, words: the buckets of whole words) from (id, label, text)."""

    def lists(row: np.ndarray, bucket: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                text, n = part.column(2), part.num_rows
                found = lists(*terms(text), n), lists(*terms(text, words=True), n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["id", "label", "buckets", "words"])

    return rows.mapInArrow(make, "id long, label int, buckets array<int>, words array<int>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, words, row of each word) of some PAIR_WORDS words of (label, words) rows at a time; a longer row is alone."""
    for batch in batches:
        off, at = batch.column(1).offsets.to_numpy(), 0
        labels, words = batch.column(0).to_numpy(), batch.column(1).values.to_numpy()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + PAIR_WORDS, side="right")) - 1)
            yield labels[at:end], words[off[at] : off[end]], np.repeat(np.arange(end - at), np.diff(off[at : end + 1]))
            at = end


def _blocks(batches: Iterator[pa.RecordBatch], odds: np.ndarray, part: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, first word, second word, label less foretold rate, its variance) of some PAIR_BLOCK pairs at a
    time: the pairs of known words of the (label, words) rows, words sorted, whose first word belongs to
    ``part`` of ``parts``. ``odds`` has by bucket the log odds of the label over those of all rows, nan if
    unknown, and at its end those of all rows."""
    bucket = np.arange(1 << BITS, dtype=U)
    mine = mix(bucket) % U(parts) == part
    # a pair's cell is the XOR of two table entries
    one, two = ((mix(bucket + U(salt << BITS)) >> U(64 - PAIR_BITS)).astype(np.int32) for salt in (1, 2))
    against = np.exp(-odds[:-1])
    base = np.exp(-odds[-1])
    for labels, w, row in _pieces(batches):
        known = ~np.isnan(odds[w])
        w, row = w[known], row[known]
        end = np.searchsorted(row, row, side="right")
        first = np.flatnonzero(mine[w] & (end - 1 > np.arange(len(w))))
        many = end[first] - 1 - first
        total, at = np.cumsum(many), 0
        while at < len(first):  # a word has at most 2^BITS partners
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIR_BLOCK, side="right")))
            i, n = first[at:to], many[at:to]
            spread = lambda x: np.repeat(x, n)  # noqa: B023, E731
            b = w[spread(i + 1 - (np.cumsum(n) - n)) + np.arange(n.sum())]
            rate = 1 / (1 + spread(against[w[i]] * base) * against[b])
            yield spread(one[w[i]]) ^ two[b], spread(w[i]), b, spread(labels[row[i]]) - rate, rate * (1 - rate)
            at = to


def sliced(rows: DataFrame, run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """``run(part, all rows)`` as one task for each of ``parts``: each reads the whole (bounded, staged) sample and
    works on its own share of the pairs, so nothing is shuffled and partial sums never meet."""
    # one branch that gives nothing and has no single partition, or Spark would run all branches as one task
    idle = rows.coalesce(2).mapInArrow(lambda batches: (b for b in batches if False), schema)
    return reduce(DataFrame.unionByName, (rows.coalesce(1).mapInArrow(partial(run, part), schema) for part in range(parts)), idle)


def paired(sample: DataFrame, odds: np.ndarray, parts: int = PAIR_PARTS) -> np.ndarray:
    """The words (buckets) of pairs that tell more than both words do alone."""
    shared = sample.sparkSession.sparkContext.broadcast(odds)
    rows = sample.select("label", "words")
    cells = 1 << PAIR_BITS

    def summed(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, var = np.zeros(cells), np.zeros(cells)
        for cell, _, _, o, v in _blocks(batches, shared.value, part, parts):
            over += np.bincount(cell, o, cells)
            var += np.bincount(cell, v, cells)
        score = np.divide(over**2, var, out=np.zeros(cells), where=var > 0)
        hot = np.flatnonzero(score >= MIN_CHI)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hot), part)), pa.array(hot), pa.array(score[hot])], names=["part", "cell", "score"])

    found = sliced(rows, summed, "part long, cell long, score double", parts).orderBy(F.desc("score"), "part", "cell").limit(HOT_CELLS).collect()
    if not found:
        return np.zeros(0, np.int64)
    hot = np.zeros((parts, cells), bool)
    hot[[r["part"] for r in found], [r["cell"] for r in found]] = True
    marked = sample.sparkSession.sparkContext.broadcast(np.packbits(hot, axis=1))

    def counted(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.unpackbits(marked.value[part]).astype(bool)
        for cell, a, b, over, var in _blocks(batches, shared.value, part, parts):
            on = np.flatnonzero(mine[cell])
            if not len(on):
                continue
            keys, at = np.unique(a[on].astype(np.int64) << BITS | b[on], return_inverse=True)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, minlength=n)), pa.array(np.bincount(at, over[on], n)), pa.array(np.bincount(at, var[on], n))], names=["pair", "d", "over", "var"])

    score = F.col("over") ** 2 / F.col("var")
    pairs = sliced(rows, counted, "pair long, d long, over double, var double", parts).groupBy("pair").agg(*(F.sum(x).alias(x) for x in ("d", "over", "var")))
    telling = pairs.where((F.col("d") >= MIN_DOCS) & (F.col("var") > 0) & (score >= MIN_CHI)).orderBy(score.desc(), "pair").limit(MAX_TERMS).select("pair").collect()
    pair = np.array([r[0] for r in telling], np.int64)
    return np.unique(np.concatenate([pair >> BITS, pair & ((1 << BITS) - 1)]))


def trained(docs: DataFrame, labels: DataFrame, max_terms: int = MAX_TERMS, train_rows: int = TRAIN_ROWS, factors: int = FACTORS, iterations: int = ITERATIONS) -> Machine:
    """Fit on ``docs`` (id, text) and ``labels`` (id, label 0 or 1; the greatest counts
    where an id has several). At most ``train_rows`` ids are taken, so they may be
    broadcast; all reads after the first are of the staged sample of hashed terms."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import CountVectorizerModel

    known = labels.where("label is not null and id is not null").groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    picked = staged(known.orderBy(F.xxhash64("id"), "id").limit(train_rows), "picked")
    sample = staged(featurized(docs.join(F.broadcast(picked), "id").select("id", "label", "text")), "terms", few=True)
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0), np.zeros((0, factors))
    if not 0 < toxic < n:
        return Machine(np.zeros(0, np.int64), 500.0 if toxic else -500.0, *none)
    seen = sample.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("d"), F.sum("label").alias("t"))
    expected = F.col("d") * F.lit(toxic / n)
    chi = (F.col("t") - expected) ** 2 / expected + (F.col("t") - expected) ** 2 / (F.col("d") - expected)
    counts = seen.where(F.col("d") >= MIN_DOCS).select("bucket", "d", "t", F.coalesce(chi, F.lit(0.0)).alias("chi")).toPandas()  # at most 2^BITS rows
    base = float(np.log(toxic / (n - toxic)))
    odds = np.full((1 << BITS) + 1, np.nan)
    # each rate is drawn towards that of all rows by one row of it
    odds[counts["bucket"]] = np.log((counts["t"] + toxic / n) / (counts["d"] - counts["t"] + 1 - toxic / n)) - base
    odds[-1] = base
    telling = counts[counts["chi"] >= MIN_CHI].sort_values(["chi", "bucket"], ascending=[False, True])["bucket"].to_numpy()[:max_terms]
    chosen = [int(b) for b in np.union1d(telling, paired(sample, odds))]
    if not chosen:
        return Machine(np.zeros(0, np.int64), base, *none)
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in chosen], "terms", "features").setBinary(True)
    rows = vectors.transform(sample.select(F.col("label").cast("double").alias("label"), F.transform("buckets", lambda b: b.cast("string")).alias("terms"))).select("label", "features")
    rows = rows.coalesce(TRAIN_PARTS).persist()
    try:
        model = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=STEP, regParam=REG, initStd=0.01, solver="adamW", seed=7).fit(rows)
    finally:
        rows.unpersist()
    return Machine(np.array(chosen, np.int64), float(model.intercept), model.linear.toArray(), model.factors.toArray())


def scored(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in the column ``score``."""
    need(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rest = docs.drop(score)
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in portions(batch, text):
                row, bucket = terms(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(row, bucket, part.num_rows))], names=[*part.schema.names, score])

    return arrow_map(rest, run, rest.withColumn(score, F.lit(0.0)).schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLD == 0


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> Machine:
    """Train on the labelled rows that are not held out."""
    need(docs, doc_id, text)
    need(labels, doc_id, label)
    lean(docs.sparkSession)
    rows = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text"))
    known = labels.where(~held_out(col(doc_id))).select(col(doc_id).alias("id"), col(label).alias("label"))
    return trained(rows, known, **options)


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    machine = fitted(docs, labels, doc_id, text, label, **options)
    out = scored(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")), machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""
    score = own("score")
    out = scored(docs, fitted(docs, labels, doc_id, text, label, **options), text, score)
    return out.where(F.col(score) < threshold).select(*map(col, docs.columns))
