"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations,
multiprobe buckets, every candidate pair verified by cosine in double precision.

A table rotates a vector by three rounds of random signs and Hadamard transform; its
code is the axis, with sign, of largest magnitude, in ``k`` independent rotations.
A vector lies in the bucket of its code (main) and of the codes by the next largest
axes (probes); a pair meets where one's main bucket is the other's main or probe. k
grows with the logarithm of the number of vectors so that buckets stay of bounded
mean size, and the number of tables follows from k and the wanted recall.

Equal vectors form one class first. Buckets are compared as blocks of at most about
BLOCK x BLOCK vectors, one matrix product a task at a time; a pair that meets
several times counts where it meets first, so blocks emit only each vector's number
of links and a spanning forest, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows that repeat
a vec_id give one result row, by the vector that is least; rows without a vec_id are
left out. Labels are never looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, components, need, staged

COSINE = 0.95
PROBES = 2
BLOCK = 2048
MEAN_BUCKET = 4096
MISS = 1e-5
ONE = 0.93  # at least: probability that one rotation's probes bring a pair of cosine 0.95 together


def plan(n: int, dim: int) -> tuple[int, int]:
    """(rotations in a code, tables) for n vectors of a dimension."""
    k = max(1, math.ceil(math.log(max(n / MEAN_BUCKET, 1.0)) / math.log(2 * max(dim, 2))))
    return k, max(2, math.ceil(math.log(MISS) / math.log(1 - ONE**k)))


def hadamard(a: np.ndarray) -> np.ndarray:
    h = 1
    while h < a.shape[1]:
        b = a.reshape(len(a), -1, 2, h)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], 2).reshape(len(a), -1)
        h *= 2
    return a / math.sqrt(a.shape[1])


def codes(x: np.ndarray, k: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, (probes + 1)^k): every code, the main one first."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    g = np.random.Generator(np.random.PCG64(width))
    out = []
    for _ in range(tables):
        axes = []
        for _ in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * g.choice([-1.0, 1.0], width))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : probes + 1]
            axes.append(best * 2 + (np.take_along_axis(y, best, 1) < 0))
        mixed = [sum(axes[j][:, c].astype(np.int64) * (2 * width) ** j for j, c in enumerate(pick)) for pick in itertools.product(range(axes[0].shape[1]), repeat=k)]
        out.append(np.stack(mixed, 1))
    return np.stack(out, 1)


def signed_vectors(vectors: DataFrame, vec_id: str, embedding: str, n: int) -> DataFrame:
    """(id, ok, h1, h2, dim, v, tables, codes): codes flat, table by table, main first."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows = [(i, None if v is None or None in v else np.array(v, np.float64)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                out = {i: {"id": r[0], "ok": False} for i, r in enumerate(rows)}
                good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and np.isfinite(v).all() and v.any()]
                for dim, group in itertools.groupby(sorted(good, key=lambda i: len(rows[i][1])), key=lambda i: len(rows[i][1])):
                    group = list(group)
                    x = np.stack([rows[i][1] for i in group])
                    x = x / np.abs(x).max(1, keepdims=True)
                    for i, c in zip(group, codes(x, *plan(n, dim)), strict=True):
                        h = np.frombuffer(hashlib.blake2b((rows[i][1] + 0.0).tobytes(), digest_size=16).digest(), np.int64)
                        out[i] |= {"ok": True, "h1": h[0], "h2": h[1], "dim": dim, "v": rows[i][1], "tables": len(c), "codes": c.ravel()}
                yield pa.RecordBatch.from_pylist(list(out.values()), schema=pa.schema([("id", pa.int64()), ("ok", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(pa.float64())), ("tables", pa.int32()), ("codes", pa.list_(pa.int64()))]))

    rows = vectors.where(col(vec_id).isNotNull()).select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<double>").alias("v"))
    return rows.mapInArrow(sign, "id long, ok boolean, h1 long, h2 long, dim int, v array<double>, tables int, codes array<long>")


def first_meeting(t: int, a: dict, b: dict) -> np.ndarray:
    """Which pairs of two blocks of one bucket of table t meet here first."""
    ca, cb = a["codes"], b["codes"]
    met = np.zeros((len(ca), len(cb)), bool)
    for u in range(t + 1):
        a_in_b, b_in_a = np.zeros_like(met), np.zeros_like(met)
        for j in range(1, ca.shape[2]):
            a_in_b |= ca[:, None, u, 0] == cb[None, :, u, j]
            b_in_a |= ca[:, None, u, j] == cb[None, :, u, 0]
        same = ca[:, None, u, 0] == cb[None, :, u, 0]
        if u < t:
            met |= same | a_in_b | b_in_a
    lower = a["id"][:, None] < b["id"][None, :]
    main_a, main_b = a["main"][:, None], b["main"][None, :]
    # the bucket where the lower id is main goes before that of the other
    here = (main_a & main_b) | (main_a & ~main_b & (lower | ~b_in_a)) | (~main_a & main_b & (~lower | ~a_in_b))
    return here & ~met


def linked(table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """Links within one pair of blocks: rows (id, other, links)."""
    first = table.slice(0, 1).to_pylist()[0]
    p, q, t, dim = first["p"], first["q"], first["t"], first["dim"]
    everything = {"id": table["id"].to_numpy(), "n": table["n"].to_numpy(), "main": table["main"].to_numpy(zero_copy_only=False), "block": table["block"].to_numpy()}
    everything["v"] = table["v"].combine_chunks().values.to_numpy().reshape(-1, dim)
    everything["codes"] = table["codes"].combine_chunks().values.to_numpy().reshape(len(table), plan(first["total"], dim)[1], -1)
    # by the largest component first: norms of very large or very small vectors stay finite and above 0
    everything["v"] = everything["v"] / np.abs(everything["v"]).max(1, keepdims=True)
    everything["v"] = everything["v"] / np.linalg.norm(everything["v"], axis=1, keepdims=True)
    a, b = ({k: v[everything["block"] == x] for k, v in everything.items()} for x in (p, q))
    hit = a["v"] @ b["v"].T >= cosine
    if p == q:
        hit &= np.triu(np.ones_like(hit), 1)
    if hit.any():
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        a, b, hit = {k: v[rows] for k, v in a.items()}, {k: v[cols] for k, v in b.items()}, hit[np.ix_(rows, cols)]
        hit &= first_meeting(t, a, b)
    ids = np.concatenate((a["id"], b["id"]))
    links = np.concatenate((hit @ b["n"], hit.T @ a["n"])) if hit.any() else np.zeros(0, np.int64)
    if not len(links):
        return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    label_a, label_b = a["id"].copy(), b["id"].copy()
    top = np.iinfo(np.int64).max
    while True:  # least id that links reach within these blocks
        new_a = np.minimum(label_a, np.where(hit, label_b[None, :], top).min(1))
        new_b = np.minimum(label_b, np.where(hit, new_a[:, None], top).min(0))
        if p == q:  # a vector stands on both sides
            both = dict(zip(a["id"].tolist(), new_a.tolist(), strict=True))
            new_b = np.array([min(y, both.get(x, y)) for x, y in zip(b["id"].tolist(), new_b.tolist(), strict=True)])
            both = dict(zip(b["id"].tolist(), new_b.tolist(), strict=True))
            new_a = np.array([min(y, both.get(x, y)) for x, y in zip(a["id"].tolist(), new_a.tolist(), strict=True)])
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    labels = np.concatenate((label_a, label_b))
    keep = (links > 0) | (labels != ids)
    return pa.table({"id": ids[keep], "other": labels[keep], "links": links[keep].astype(np.int64)})


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row for each vec_id: vec_id, n_links (other vectors with cosine >= ``cosine``),
    component_id (smallest vec_id reachable by links), kept (vec_id = component_id)."""
    need(vectors, vec_id, embedding)
    total = vectors.count()
    sig = staged(signed_vectors(vectors, vec_id, embedding, total), "vectors")
    once = sig.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("ok", "h1", "h2")).alias("x"))
    ids = staged(once.select("id", "x.*"), "ids")
    classes = ids.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    reps = sig.join(classes, ["id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "n", "dim", "v", "tables", "codes")
    each = (F.size("codes") / F.col("tables")).cast("int")
    rows = reps.withColumn("each", each).select("*", F.posexplode("codes").alias("at", "code"))
    rows = rows.select("id", "n", "dim", "v", "codes", (F.col("at") / F.col("each")).cast("int").alias("t"), "code", (F.col("at") % F.col("each") == 0).alias("main"))
    keys = ["dim", "t", "code"]
    small = sig.where("ok").join(classes.select("id"), "id").select("dim", each.alias("each"), F.posexplode("codes").alias("at", "code"))
    large = small.select("dim", (F.col("at") / F.col("each")).cast("int").alias("t"), "code").groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    large = staged(large.select(*keys, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    rows = rows.join(F.broadcast(large) if large.count() <= 100_000 else large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("block", "with")).withColumn("q", F.greatest("block", "with")).withColumn("total", F.lit(total)).drop("with", "blocks")
    found = staged(rows.groupBy(*keys, "p", "q").applyInArrow(lambda t: linked(t, cosine), "id long, other long, links long"), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = ids.where("ok").join(classes.withColumnRenamed("id", "rep"), ["h1", "h2"]).select("id", "rep", "n")
    member = member.join(direct.withColumnRenamed("id", "rep"), "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    out = member.select(F.col("id").alias("vec_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = ids.where("not ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
