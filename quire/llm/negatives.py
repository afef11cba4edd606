"""Hard-negative mining: for anchors among the vectors of a table, the rows of the same label
that score highest (positives) and, for each, the rows of another label whose scores lie in a
window under the positive's.

A score is the integer inner product of the vectors' components x taken as floor(256 x).
Every vector is stored with a summary of its segments: for SEGMENTS segments, coarse to fine,
each segment's mean and its deviation (the norm of what is left of the segment without its mean). For
two vectors a segment's part of the inner product lies within deviation times
deviation of length times mean times mean, so sums over segments bound the score from both sides. A
block of anchors meets a block of vectors at the coarsest summary first; only vectors
that some anchor's bounds leave open go on to the next, finer one, and only what is open at
the end is scored exactly. Bounds never close a row that belongs to the answer.

Rows are dealt into blocks by the hash of their id, whatever their label, so that hot
labels and copies of a vector fill all blocks alike. Every block of anchors meets every block of vectors as
one cogrouped task; it gives at most as many rows for each anchor as the answer has.

Defined results: rows without an id take no part, nor do rows with a null label or vector, null or
non-finite components, or no component. Rows that repeat an id count once, by the least
label, then vector. Vectors of other widths do not meet. Rows whose integer components' squares sum to
2^52 or more would not be exact in 64-bit arithmetic and take no part.
Equal scores go by the smaller id. An anchor without other rows of its label gives no row; nor does a positive
without a negative in its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, need, staged

SCALE = 256
SEGMENTS = (4, 16)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score, in hundredths of its positive's
ANCHORS = 1024  # anchors in a block, at most about
VECTORS = 4096
SPREAD = 32  # blocks of vectors at least, so that small tables use many tasks too
NONE = -np.inf


def summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the square root of the length) and deviations of the segments of the rows
    of x, level by level: two arrays of as many columns as SEGMENTS sum to."""
    means, deviations = [], []
    for n in SEGMENTS:
        for part in np.array_split(x, n, axis=1):
            width = part.shape[1]
            mean = part.mean(1, keepdims=True) if width else np.zeros((len(x), 1))
            means.append(mean[:, 0] * np.sqrt(width))
            deviations.append(np.sqrt(((part - mean) ** 2).sum(1)) if width else np.zeros(len(x)))
    return np.stack(means, 1), np.stack(deviations, 1)


def summarized(rows: DataFrame) -> DataFrame:
    """(id, label, dim, x, mean, deviation) of rows (id, label, v) that take part."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy()
            values = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            width, valid = np.diff(off), lists.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(width[valid & (width > 0)]):
                at = np.flatnonzero(valid & (width == dim))
                x = values[off[at][:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(1)
                x = np.floor(np.where(fine[:, None], np.clip(x, -1e300, 1e300), 0.0) * SCALE)
                with np.errstate(over="ignore"):
                    fine &= (x * x).sum(1) < 2.0**52
                at, x = at[fine], x[fine]
                if not len(at):
                    continue
                mean, deviation = summary(x)
                lists_of = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), lists_of(x.astype(np.int64)), lists_of(mean), lists_of(deviation)], names=["id", "label", "dim", "x", "mean", "deviation"])

    return rows.mapInArrow(make, "id long, label long, dim int, x array<long>, mean array<double>, deviation array<double>")


class Block:
    """The rows of one block by id, as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("id")
        grid = lambda name, t=np.float64: table[name].combine_chunks().flatten().to_numpy().reshape(len(table), -1).astype(t)
        self.id, self.label, self.table = table["id"].to_numpy(), table["label"].to_numpy(), table
        self.x, self.mean, self.deviation = grid("x"), grid("mean"), grid("deviation")

    def lists(self, name: str, width: int) -> np.ndarray:
        """A list column as rows of ``width``, filled up with 0."""
        out = np.zeros((len(self.id), width), np.int64)
        for i, v in enumerate(self.table[name].to_pylist()):
            out[i, : len(v)] = v
        return out


def bounds(a: Block, b: Block, level: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of a's rows and some of b's, at a level of the summary."""
    at = slice(sum(SEGMENTS[:level]), sum(SEGMENTS[: level + 1]))
    middle, reach = a.mean[:, at] @ b.mean[rows, at].T, a.deviation[:, at] @ b.deviation[rows, at].T
    reach += 1e-9 * (np.abs(middle) + reach) + 1e-6  # of rounding
    return middle - reach, middle + reach


def opened(a: Block, b: Block, able: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, k: int = 0) -> np.ndarray:
    """Those of the ``able`` pairs whose score may lie from ``low`` to ``high`` of their anchor;
    without ``low``, that may be among an anchor's k highest."""
    able = able.copy()
    for level in range(len(SEGMENTS)):
        rows = np.flatnonzero(able.any(0))
        if not len(rows):
            break
        least, most = bounds(a, b, level, rows)
        part = able[:, rows]
        if low is None:
            if len(rows) > k:
                floor = np.partition(np.where(part, least, NONE), len(rows) - k, axis=1)[:, len(rows) - k]
                part &= most >= floor[:, None]
        else:
            part &= (most >= low[:, None]) & (least <= high[:, None])
        able[:, rows] = part
    return able


def highest(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of the k highest of each row, one at a time; equal ones by column.
    ``scores`` is used up."""
    for _ in range(min(k, scores.shape[1])):
        best = scores.argmax(1)
        rows = np.flatnonzero(scores[np.arange(len(best)), best] > NONE)
        if not len(rows):
            return
        yield rows, best[rows]
        scores[rows, best[rows]] = NONE


def exact(a: Block, b: Block, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of b, scores): exact scores of the pairs still open, NONE elsewhere."""
    rows = np.flatnonzero(able.any(0))
    return rows, np.where(able[:, rows], a.x @ b.x[rows].T, NONE)


def long_table(**columns: list) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64(), safe=False) for k, v in columns.items()})


def nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(anchor, other, score): the k highest rows of an anchor's label in one block of vectors."""
    out = {"anchor": [], "other": [], "score": []}
    if len(left) and len(right):
        a, b = Block(left), Block(right)
        able = (a.label[:, None] == b.label[None, :]) & (a.id[:, None] != b.id[None, :])
        cols, scores = exact(a, b, opened(a, b, able, None, None, k))
        kept = scores.copy()
        for i, j in highest(scores, k):
            out["anchor"].append(a.id[i])
            out["other"].append(b.id[cols[j]])
            out["score"].append(kept[i, j].astype(np.int64))
    return long_table(**out)


def within(left: pa.Table, right: pa.Table, k: int, width: int, low: int, high: int) -> pa.Table:
    """(anchor, positive, other, positive_score, score): for each positive of an anchor the k highest rows of
    another label in its window, in one block of vectors."""
    out = {"anchor": [], "positive": [], "other": [], "positive_score": [], "score": []}
    if len(left) and len(right):
        a, b = Block(left), Block(right)
        ids, tops = a.lists("positives", width), a.lists("scores", width)
        given = np.arange(width)[None, :] < a.table["scores"].combine_chunks().value_lengths().to_numpy()[:, None]
        least, most = -(-low * tops // 100), high * tops // 100
        some = given & (least <= most)
        able = (a.label[:, None] != b.label[None, :]) & some.any(1)[:, None]
        cols, scores = exact(a, b, opened(a, b, able, np.where(some, least, np.inf).min(1), np.where(some, most, NONE).max(1)))
        for p in range(width):
            inside = np.where(some[:, p : p + 1] & (scores >= least[:, p : p + 1]) & (scores <= most[:, p : p + 1]), scores, NONE)
            for i, j in highest(inside, k):
                out["anchor"].append(a.id[i])
                out["positive"].append(ids[i, p])
                out["other"].append(b.id[cols[j]])
                out["positive_score"].append(tops[i, p])
                out["score"].append(scores[i, j].astype(np.int64))
    return long_table(**out)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest rows of ``found`` by ``keys``, with their ``rank``; less than k rows a key and block come in."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row for each anchor, positive and hard negative: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. ``anchor`` marks the anchors among the rows
    (null: no), ``label`` is the label that counts; a negative's score is from ``low`` to ``high``
    hundredths of its positive's, both ends included."""
    need(vectors, vec_id, embedding)
    rows = vectors.select(col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), col(embedding).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and v is not null")
    marks = rows.groupBy("id").agg(F.max("anchor").alias("anchor"), F.count(F.lit(1)).alias("n"))
    marks = staged(marks, "vector-ids")
    table = summarized(rows.select("id", "label", "v"))
    again = marks.where("n > 1").select("id")
    # only ids that do repeat are grouped
    once = table.join(again, "id", "left_anti").unionByName(table.join(again, "id").groupBy("id").agg(F.min(F.struct("label", "x", "dim", "mean", "deviation")).alias("r")).select("id", "r.label", "r.dim", "r.x", "r.mean", "r.deviation"))
    table = staged(once, "segment-summaries")
    chosen = marks.where("anchor").select("id")
    total, picked = table.count(), chosen.count()
    blocks, groups = max(SPREAD, -(-total // VECTORS)), max(1, -(-picked // ANCHORS))
    block_of = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = staged(table.join(chosen, "id", "left_semi").withColumn("q", block_of("anchor", groups)), "anchors")
    right = table.withColumn("p", block_of("vector", blocks)).withColumn("q", every(groups)).groupBy("dim", "p", "q")

    def meet(left: DataFrame, run, schema: str) -> DataFrame:
        return left.withColumn("p", every(blocks)).groupBy("dim", "p", "q").cogroup(right).applyInArrow(run, schema)

    near = meet(anchors, lambda a, b: nearest(a, b, positives), "anchor long, other long, score long")
    near = best_of(near, ["anchor"], positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("r"))
    near = staged(near.select(F.col("anchor").alias("id"), F.col("r.other").alias("positives"), F.col("r.score").alias("scores")), "positives")
    schema = "anchor long, positive long, other long, positive_score long, score long"
    hard = meet(anchors.join(near, "id"), lambda a, b: within(a, b, negatives, positives, low, high), schema)
    out = best_of(staged(hard, "windows"), ["anchor", "positive"], negatives)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Contract of op11: which rows are anchors, and which rows' labels are moved.
EVERY, MOVED, LABELS = 50, 7, 10


def negatives_report(vectors: DataFrame) -> DataFrame:
    """op11's rows: anchors are the ids divisible by 50; where an id is divisible by 7, the label moves on by one."""
    i, kind = F.col("vec_id"), F.col("label").cast("long")
    return hard_negatives(vectors, i % EVERY == 0, F.when(i % MOVED == 0, (kind + 1) % LABELS).otherwise(kind))


NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
