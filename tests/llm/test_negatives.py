"""Hard negatives against plain counting over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives as N


def plain(rows, positives=N.POSITIVES, negatives=N.NEGATIVES, low=N.LOW, high=N.HIGH):
    """op11 over (vec_id, embedding, label) by Python integers."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(256 * float(c))) for c in v]
        if sum(c * c for c in x) < 2**52:
            good[i] = min(good.get(i, ((label + 1) % 10 if i % 7 == 0 else label, x)), ((label + 1) % 10 if i % 7 == 0 else label, x))
    out = []
    for a, (kind, x) in good.items():
        if a % 50:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i) for i, (_, y) in good.items() if i != a and len(y) == len(x))
        tops = [(-s, i) for s, i in scores if good[i][0] == kind][:positives]
        for top, p in tops:
            hard = [(-s, i) for s, i in scores if good[i][0] != kind and low * top <= 100 * -s <= high * top][:negatives]
            out += [(a, p, n + 1, i, top, s) for n, (s, i) in enumerate(hard)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, embedding array<double>, label int, id long, x string, `a.b c` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def crowd(n=900, dim=20, seed=5):
    g = np.random.default_rng(seed)
    base = g.normal(size=(10, dim))
    rows = [(i, (base[i % 10] * 0.5 + g.normal(size=dim) * 0.6).tolist(), int((i + (i % 4 == 0)) % 10)) for i in range(n)]
    rows += [(2000 + i, rows[0][1], i % 3) for i in range(400)]  # copies of a vector, under several labels
    return rows


@pytest.mark.parametrize(("vectors", "anchors"), [(4096, 1024), (40, 6)])
def test_equals_plain_version(spark, monkeypatch, vectors, anchors):
    monkeypatch.setattr(N, "VECTORS", vectors)
    monkeypatch.setattr(N, "ANCHORS", anchors)
    rows = crowd()
    want = plain(rows)
    assert len(want) > 100
    assert got(N.negatives_report(frame(spark, rows))) == want


def test_defined_results(spark):
    e = [0.5] * 4
    rows = [(0, e, 0), (50, [1.0, 0.0, 0.0, 0.0], None), (1, e, 0), (1, e, 0), (2, [0.4] * 4, 1), (3, [0.4] * 4, 2), (16, [0.3] * 4, 2), (None, e, 1)]
    rows += [(100, None, 0), (4, [], 0), (5, [None, 1.0, 1.0, 1.0], 1), (6, [float("nan")] * 4, 1), (8, [float("inf")] * 4, 1), (9, [1e200] * 4, 1), (10, [-1e300] * 4, 0)]
    rows += [(150, [1.0, 1.0], 3), (11, [1.0, 1.0], 3), (12, [0.9, 0.9], 4), (200, [-1.0, 0.0, 0.0], 5), (13, [1.0, 0.0, 0.0], 5), (15, [1.0, 0.0, 0.0], 6)]
    want = plain(rows)
    assert got(N.negatives_report(frame(spark, rows))) == want
    assert {r[0] for r in want} == {0, 150}
    assert N.negatives_report(frame(spark, [])).collect() == []
    assert N.negatives_report(frame(spark, [(50, e, 1), (1, e, 2)])).collect() == []


def test_general_interface(spark):
    rows = crowd(200, 7)
    df = frame(spark, rows).withColumnRenamed("vec_id", "key")
    out = N.hard_negatives(df, F.col("key") % 20 == 0, F.col("label"), "key", positives=2, negatives=4, low=10, high=100)
    assert {r["rank"] for r in out.collect()} <= {1, 2, 3, 4}
    assert out.groupBy("anchor_id").agg(F.countDistinct("positive_id").alias("n")).where("n > 2").count() == 0


def block(x):
    mean, dev = N.summary(x)
    return N.Block(pa.table({"id": np.arange(len(x)), "label": np.zeros(len(x), np.int64), "x": list(x), "mean": list(mean), "deviation": list(dev)}))


@pytest.mark.parametrize("dim", [1, 3, 16, 50, 64])
def test_bounds_hold_and_narrow(dim):
    g = np.random.default_rng(dim)
    x, y = (np.floor(256 * np.cumsum(g.normal(size=(60, dim)), axis=1)) for _ in range(2))
    a, b = block(x), block(y)
    score, last = x @ y.T, None
    for level in range(len(N.SEGMENTS)):
        low, high = N.bounds(a, b, level, np.arange(60))
        assert (low <= score).all() and (score <= high).all()
        if last is not None:
            assert (high - low).mean() <= last * (1 + 1e-6)
        last = (high - low).mean()
    able = np.ones((60, 60), bool)
    for k in (1, 5):
        left = N.opened(a, b, able, None, None, k)
        for i in range(60):
            assert left[i, np.lexsort((np.arange(60), -score[i]))[:k]].all()
    least, most = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.95, axis=1)
    left = N.opened(a, b, able, least, most)
    assert left[(score >= least[:, None]) & (score <= most[:, None])].all()
    if dim == 64:
        assert left.mean() < 0.5  # smooth vectors: most pairs are settled by their summaries
