"""Mixing: targets by hand, nearness, caps, reruns."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as M


def targets(spark, sizes, **options):
    rows = M.weighted_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), **options).collect()
    return {r["source"]: r["target"] for r in rows}


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Shares by weight; what is over a cap is shared anew until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets(spark):
    r = random.Random(3)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"src{i}": r.choice([0, 1, 10, 1000, 10**6]) for i in range(n)} | ({None: 77} if n > 2 else {})
        got, want = targets(spark, sizes), plain_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9), (sizes, s)


def corpus():
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 50, 300])), r.choice(["hot", "hot", "hot", "b", "é", None])) for i in range(3000)]
    return rows + [(5000, None, "b"), (5001, "", "nothing"), (5002, "one word two\n\tthree", "b")]


def test_mix_is_near_and_capped_and_repeats(documents):
    docs = documents(corpus())
    rows = M.mix_report(docs).collect()
    again = M.mix_report(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(rows) == len(corpus()) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    by_id = {i: (s, t) for i, t, s in corpus()}
    assert {r["doc_id"]: r["size"] for r in rows}[5002] == 3 and {r["doc_id"]: r["size"] for r in rows}[5000] == 0
    sizes, taken, want = {}, {}, {}
    for r in rows:
        s = by_id[r["doc_id"]][0]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        want[s] = r["target"]
        assert r["size"] == len((by_id[r["doc_id"]][1] or "").replace(" ", "x").split())
    assert {r["source_size"] for r in rows} == set(sizes.values())
    for s, t in plain_targets(sizes).items():
        assert want[s] == pytest.approx(t) and abs(taken[s] - t) <= 300, s
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_newton_meets_targets_under_priors_and_caps(spark):
    cells = spark.createDataFrame([("a", p / 4, 100) for p in range(1, 9)] + [("b", 1.0, 50)], "source string, prior double, tokens long")
    want = spark.createDataFrame([("a", 800, 1300.0), ("b", 50, 99.99)], "source string, source_size long, target double")
    lam = {r["source"]: r["lam"] for r in M.multipliers(cells, want).collect()}
    import math

    assert sum(100 * min(2.0, p / 4 * math.exp(lam["a"])) for p in range(1, 9)) == pytest.approx(1300, rel=1e-9)
    assert 50 * min(2.0, math.exp(lam["b"])) == pytest.approx(99.99, rel=1e-9)


def test_prior_tilts(documents):
    docs = documents([(i, "w " * 10, "s") for i in range(2000)])
    rows = M.parameters(docs, prior=F.when(F.col("doc_id") < 1000, 0.5).otherwise(1.5), share=0.8)
    assert {r["prior"]: round(r["rate"], 6) for r in rows[1].collect()} == {0.5: 0.4, 1.5: 1.2}


def test_empty(documents):
    docs = documents([(1, "a", "s")]).limit(0)
    assert M.mix_report(docs).count() == 0 and M.mixed(docs).count() == 0
    assert [tuple(r)[:5] for r in M.mix_report(documents([(1, None, None), (1, "", None)])).collect()] == [(1, 0, 0, 0.0, 0)] * 2
