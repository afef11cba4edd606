"""Embedding links against all pairs in numpy."""

import numpy as np
import pytest

from quire.llm import vectors as V


def brute(rows):
    ok = {}
    for i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        ok[i] = x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None
    ids = list(ok)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = ok[i], ok[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= V.COSINE:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def crowd(n=300, dim=24, seed=1):
    g = np.random.default_rng(seed)
    base = g.normal(size=(12, dim))
    near = [base[i % 12] + g.normal(size=dim) * (0.05 + 0.02 * (i % 7)) for i in range(n)]
    rows = [(i * 3, v.tolist()) for i, v in enumerate(near)]
    rows += [(5000 + i, near[0].tolist()) for i in range(20)]  # exact copies
    rows += [(6000, (near[1] * 1e-30).tolist()), (6001, (near[1] * 1e30).tolist()), (6002, (-near[1]).tolist())]
    rows += [(7000, None), (7001, []), (7002, [0.0] * dim), (7003, [float("nan")] * dim), (7004, [float("inf")] + [1.0] * (dim - 1)), (7005, [None] * dim), (7006, [1.0, 2.0, 3.0]), (7007, [2.0, 4.0, 6.0]), (7008, [5.0]), (7009, [7.0])]
    return rows


@pytest.mark.parametrize("block", [2048, 25])
def test_equals_all_pairs(spark, block):
    rows = crowd()
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id long, `a.b` string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.embedding_links(df, block=block).collect()}
    assert got == brute(rows)
    assert max(n for n, _, _ in got.values()) > 25


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.embedding_links(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0])]
    got = sorted(tuple(r) for r in V.embedding_links(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [3.0, 3.0]), (5, [-1e308, 1e-308]), (6, [5e-324, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_recall_of_the_hash_at_the_threshold():
    g = np.random.default_rng(3)
    for n, dim in ((10**5, 64), (10**9, 64), (10**5, 24), (10**5, 768)):
        k, tables = V.plan(n, dim)
        x = g.normal(size=(1500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = g.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        y = V.COSINE * x + np.sqrt(1 - V.COSINE**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = V.codes(x, k, tables), V.codes(y, k, tables)
        met = (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)
        assert met.any(1).mean() > 0.995, (n, dim, k, tables)
