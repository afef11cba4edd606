"""Toxicity: held-out accuracy, interactions, edges."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from conftest import SF_MID  # tests/conftest.py
from pyspark.sql import functions as F

from quire.llm import toxicity as X


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    out = X.toxicity_report(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count("*")).first()
    assert seen[1] > 50 and seen[0] > 0.93
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0


def test_learns_what_only_a_pair_tells(spark):
    """Toxic if both or neither of two words stand: no linear weights can tell."""
    r = random.Random(1)
    rows = []
    for i in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"n{r.randint(0, 200)}" for _ in range(6)] + ["insult"] * a + ["group"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "id long, text string, label int")
    m = X.trained(df.select("id", "text"), df.select("id", "label"))
    texts = ["n1 insult n2 n3", "n1 group n2 n3", "n1 insult n2 group", "group n5 n6 insult", "n1 n2", None, ""]
    s = m.scores(*X.terms(pa.array(texts)), len(texts))
    assert s[2] > 0.5 and s[3] > 0.5 and max(s[0], s[1], s[4], s[5], s[6]) < 0.5


def test_learns_a_pair_whose_words_tell_nothing_alone(spark):
    """Toxic if both or neither of two words stand, never side by side: each word's own
    chi-square with the label is far under the mark."""
    r = random.Random(3)

    def text(a, b):
        n = [f"n{r.randint(0, 200)}" for _ in range(6)]
        return " ".join([n[0], "insult" if a else n[1], n[2], n[3], "group" if b else n[4], n[5]])

    kinds = [(bool(i & 1), bool(i & 2)) for i in range(2400)]
    df = spark.createDataFrame([(i, text(a, b), int(a == b)) for i, (a, b) in enumerate(kinds[:2000])], "id long, text string, label int")
    m = X.trained(df.select("id", "text"), df.select("id", "label"))
    new = [text(a, b) for a, b in kinds[2000:]]
    s = m.scores(*X.terms(pa.array(new)), len(new))
    assert sum((p > 0.5) == (a == b) for p, (a, b) in zip(s, kinds[2000:], strict=True)) > 360


def test_edges(documents, spark):
    rows = [(1, "fine words"), (2, None), (3, ""), (4, "x " * 300_000), (4, "twice"), (None, "no id")]
    docs = documents(rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in X.toxicity_report(docs, none).collect())
    kept = X.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6
    assert X.toxicity_report(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert X.toxicity_report(docs, odd).count() == 6


def test_labels_of_held_out_rows_are_not_learnt(documents, spark):
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = documents([(i, "bad word" if i in held else "good word") for i in range(400)])
    labels = spark.createDataFrame([(i, int(i in held)) for i in range(400)], "doc_id long, toxic int")
    out = X.toxicity_report(docs, labels)
    assert {r["doc_id"] for r in out.where("held_out").collect()} == set(held)
    assert out.where("predicted = 1").count() == 0


def plain_pairs(rows, odds, least=X.MIN_DOCS, mark=X.MIN_CHI):
    """Words of telling pairs of (label, words) by a dictionary of all pairs."""
    sums = {}
    for label, words in rows:
        known = [w for w in words if not np.isnan(odds[w])]
        for a, b in itertools.combinations(known, 2):
            rate = 1 / (1 + math.exp(-(odds[a] + odds[b] + odds[-1])))
            d, over, var = sums.get((a, b), (0, 0.0, 0.0))
            sums[a, b] = d + 1, over + label - rate, var + rate * (1 - rate)
    return sorted({w for p, (d, over, var) in sums.items() if d >= least and var > 0 and over**2 / var >= mark for w in p})


def test_pair_sums_equal_a_plain_count(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        words = {r.randint(0, 60) * 1000 for _ in range(r.choice([0, 1, 5, 12]))} | ({7, 123_456} if i % 3 == 0 else {7} if i % 3 == 1 else {123_456})
        rows.append((int(i % 3 == 0 or r.random() < 0.05), sorted(words)))
    odds = np.full((1 << X.BITS) + 1, np.nan)
    odds[[*range(0, 50_000, 1000), 7, 123_456]] = 0.1
    odds[-1] = -0.6
    df = spark.createDataFrame(rows, "label int, words array<int>").repartition(5)
    want = plain_pairs(rows, odds)
    assert {7, 123_456} <= set(want)
    for parts in (1, 3, X.PAIR_PARTS):
        assert X.paired(df, odds, parts).tolist() == want


def test_blocks_of_a_text_of_many_words(monkeypatch):
    """All pairs of a long text once, a bounded number at a time, shared by the parts."""
    monkeypatch.setattr(X, "PAIR_BLOCK", 5000)
    n = 700
    odds = np.zeros((1 << X.BITS) + 1)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1]), pa.array([[], list(range(3, n + 3)), [5]], pa.list_(pa.int32()))], names=["label", "words"])
    seen = []
    for part in range(4):
        for cell, a, b, over, var in X._blocks([batch], odds, part, 4):
            assert len(a) == len(cell) == len(over) <= 5000 + n and (over == -0.5).all() and (var == 0.25).all() and (a < b).all()
            seen.append(a.astype(np.int64) << X.BITS | b)
    seen = np.concatenate(seen)
    assert len(np.unique(seen)) == len(seen) == n * (n - 1) // 2


def test_many_distinct_words(spark):
    words = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(i, words if i % 2 else f"w{i}", i % 2) for i in range(8)], "id long, text string, label int")
    m = X.trained(df.select("id", "text"), df.select("id", "label"))
    assert len(m.scores(*X.terms(pa.array([words])), 1)) == 1


def test_scores_equal_the_plain_double_sum():
    g = np.random.default_rng(4)
    buckets = np.sort(g.choice(1 << X.BITS, 40, replace=False))
    m = X.Machine(buckets, 0.3, g.normal(size=40), g.normal(size=(40, 3)) * 0.3)
    lists = [sorted(g.choice(buckets, k, replace=False).tolist() + [1, 2]) for k in (0, 1, 2, 9, 40)]
    got = m.scores(np.repeat(np.arange(5), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), 5)
    for p, words in zip(got, lists, strict=True):
        at = [int(np.flatnonzero(buckets == w)[0]) for w in words if w in buckets]
        z = m.intercept + sum(m.linear[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(at, 2))
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9


def test_pair_work_fills_no_memory():
    """A full Arrow batch of words is paired in little memory, every pair once."""
    import tracemalloc

    n, k = 20_000, 60
    words = np.sort(np.random.default_rng(2).integers(0, 1 << X.BITS, (n, k), np.int32), axis=1)
    words += np.arange(k, dtype=np.int32)  # distinct
    words = np.minimum(words, (1 << X.BITS) - k + np.arange(k, dtype=np.int32))
    off = pa.array(np.arange(n + 1, dtype=np.int32) * k)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.ListArray.from_arrays(off, pa.array(words.ravel()))], names=["label", "words"])
    odds = np.zeros((1 << X.BITS) + 1)
    tracemalloc.start()
    pairs = sum(len(cell) for cell, *_ in X._blocks([batch], odds, 0, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == n * k * (k - 1) // 2
    assert peak < 40 << 20
