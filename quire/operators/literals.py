"""Exact search for secret values inside whole texts.

A value is found wherever its characters stand, blanks and punctuation included, also inside a longer word.
Values are turned into numbers at once and never reach a plan, a broadcast or a result:

* its length, an *anchor* (a mixed hash of its first 8 bytes, or of as many as the
  largest power of two it has), a rolling hash of all its bytes and its SHA-256;
* a text's anchors at all byte positions are a few shifted array operations. A position
  whose anchor is known is compared, for each length that this anchor has, by the rolling hash
  of so many bytes, which prefix sums give at once; what agrees is settled by SHA-256.

So the work follows the text and its anchor hits, not the number of values. Up to
MAX_BROADCAST_LITERALS hashed values (32 MB) go to the tasks at a time; more run as
passes over slices of them, each written before the next is fetched.

Defined results: null and empty values are never found, null texts hold nothing; repeated
values and rows count once; matching is by code points as they stand (no case folding).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_dir

MAX_BROADCAST_LITERALS = 500_000
PIECE = 1 << 18  # text positions worked on at once
STEP = 1 << 16  # anchor hits compared at once
GRAMS = (1, 2, 4, 8)
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def _mixed(x: np.ndarray, salt) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = (x + np.asarray(salt, U)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


class _Bytes:
    """Anchors and rolling hashes of a stretch of bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(1 << max(12, int(len(data)).bit_length()))
        self.grams = {1: data.astype(U)}
        for n in GRAMS[:-1]:
            low = self.grams[n]
            self.grams[2 * n] = low[: max(len(low) - n, 0)] | low[n:] << U(8 * n)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)], out=self.sums[1:])

    def anchors(self, gram: int) -> np.ndarray:
        return _mixed(self.grams[gram], gram)

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.down[at], length)


def _gram(length: int) -> int:
    return max(g for g in GRAMS if g <= length)


HASHED = T.StructType([T.StructField("length", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("rolling", T.LongType()), T.StructField("digest", T.BinaryType())])


def hashed_values(literals: DataFrame, value_col: str) -> DataFrame:
    """(length, anchor, rolling, digest) of every distinct value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                raw = (value or "").encode()
                if raw:
                    b = _Bytes(np.frombuffer(raw, np.uint8))
                    rows.append((len(raw), b.anchors(_gram(len(raw)))[0].view(np.int64), b.hashes(np.zeros(1, np.int64), len(raw))[0].view(np.int64), hashlib.sha256(raw).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(x) if k < 3 else x for x in c], t) for k, (c, t) in enumerate(zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=HASHED.names)

    return literals.select(F.col(value_col).cast("string").alias("v")).where("v <> ''").mapInArrow(run, HASHED).distinct()


@dataclass
class Values:
    """Hashed values of one pass, by gram: sorted anchors with their lengths (those of anchor i lie
    from first[i] to first[i + 1]); sorted rolling hashes."""

    anchors: dict[int, np.ndarray]
    lengths: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    rolling: np.ndarray
    digests: list[list[bytes]]  # of each rolling hash
    longest: int


def values_of(rows: list) -> Values:
    by: dict[int, dict[int, set[int]]] = {}
    known: dict[int, list[bytes]] = {}
    for length, anchor, rolling, digest in rows:
        by.setdefault(_gram(length), {}).setdefault(anchor % (1 << 64), set()).add(length)
        known.setdefault(rolling % (1 << 64), []).append(bytes(digest))
    anchors = {g: np.array(sorted(a), U) for g, a in by.items()}
    lengths = {g: np.array([n for x in sorted(by[g]) for n in sorted(by[g][x])]) for g in by}
    first = {g: np.cumsum([0, *(len(by[g][x]) for x in sorted(by[g]))]) for g in by}
    rolling = sorted(known)
    return Values(anchors, lengths, first, np.array(rolling, U), [known[r] for r in rolling], max((r[0] for r in rows), default=0))


def _hit(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the sorted values, -1 where it is none of them."""
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def found_in(data: np.ndarray, off: np.ndarray, values: Values) -> Iterator[tuple[int, bytes]]:
    """(row, digest) of the values that stand in rows of bytes, perhaps repeatedly."""
    for start in range(int(off[0]), int(off[-1]), PIECE):
        end = min(start + PIECE, int(off[-1]))
        part = data[start : min(end + values.longest, int(off[-1]))]
        b = _Bytes(part)
        for gram, anchors in values.anchors.items():
            place = _hit(anchors, b.anchors(gram)[: end - start])
            at = np.flatnonzero(place >= 0)
            if not len(at):
                continue
            row = np.searchsorted(off, at + start, side="right") - 1
            room = off[row + 1] - (at + start)
            first = values.first[gram]
            for lo in range(0, len(at), STEP):  # each hit with each length of its anchor
                which, p, r, free = (x[lo : lo + STEP] for x in (place[at], at, row, room))
                many = first[which + 1] - first[which]
                before = np.cumsum(many) - many
                length = values.lengths[gram][np.repeat(first[which] - before, many) + np.arange(many.sum())]
                p, r, free = (np.repeat(x, many) for x in (p, r, free))
                fits = length <= free
                p, r, length = p[fits], r[fits], length[fits]
                same = _hit(values.rolling, b.hashes(p, length))
                on = np.flatnonzero(same >= 0)
                key = r[on] * len(values.rolling) + same[on]
                for j in on[np.unique(np.stack([key, length[on]]), axis=1, return_index=True)[1]] if len(on) else ():
                    digest = hashlib.sha256(part[p[j] : p[j] + length[j]].tobytes()).digest()
                    if digest in values.digests[same[j]]:
                        yield int(r[j]), digest


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    arr = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def scan_literals(df: DataFrame, id_col: str, text_col: str, literals: DataFrame, value_col: str = "value", most: int = MAX_BROADCAST_LITERALS) -> DataFrame:
    """(row_id, literal_hash): each row whose text contains a value, with the value's SHA-256 in hex."""
    spark = df.sparkSession
    path = shared_dir(spark, "literals")
    hashed_values(literals, value_col).write.parquet(path)
    known = spark.read.schema(HASHED).parquet(path)
    total = known.count()
    texts = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([texts.schema["row_id"], T.StructField("literal_hash", T.StringType())])

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = shared.value
            for batch in batches:
                pairs = sorted(set(found_in(*_text_bytes(batch.column(1)), values))) if len(values.rolling) and batch.num_rows else []
                if pairs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in pairs])), pa.array([d.hex() for _, d in pairs])], names=["row_id", "literal_hash"])

        return texts.mapInArrow(run, kind).distinct()

    if total <= most:
        return search(spark.sparkContext.broadcast(values_of(known.collect())))
    # slices by hash, of half the bound on average; a slice over the bound is cut again
    root, slices = shared_dir(spark, "literal-hits"), [(F.lit(True), total, 0)]
    while slices:
        cond, n, depth = slices.pop()
        if n > most:
            parts = -(-2 * n // most)
            for p in range(parts):
                sub = cond & (F.pmod(F.xxhash64("digest", F.lit(depth)), F.lit(parts)) == p)
                slices.append((sub, known.where(sub).count(), depth + 1))
        elif n:
            shared = spark.sparkContext.broadcast(values_of(known.where(cond).collect()))
            search(shared).write.mode("append").parquet(root)
            shared.destroy()
    return spark.read.schema(kind).parquet(root)
