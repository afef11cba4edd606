"""Near duplicates against all pairs by brute force."""

import random

import pyarrow as pa
import pytest
from conftest import SF_SMALL  # tests/conftest.py
from pyspark.sql import functions as F

from quire.llm import neardup as N
from quire.llm.words import Words


def brute(docs):
    """doc_id -> component by comparing all pairs."""
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None}, key=lambda r: r[0])
    sampler = N.Sampler(N.idf_codes(docs, "text"))
    sets = []
    for _, t in rows:
        _, key, tf = N.shingles(Words(pa.array([t], pa.string())))
        w = sampler.weights(key, tf)
        sets.append((key, w, float(w.sum())))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, t) in enumerate(rows):
        for j in range(i):
            same = t is not None and t == rows[j][1]
            if same or N.jaccard(*sets[i], *sets[j]) >= N.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def found(docs):
    return {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def crowd(seed=5):
    """A group of near copies, an exact copy, and many texts around one passage."""
    r = random.Random(seed)
    base, passage = words(r, 80), words(r, 40)
    rows = []
    for i in range(60):
        t = list(base)
        t[r.randrange(len(t))] = f"edit{i}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(words(r, 12) + passage + words(r, 12))) for i in range(60)]
    rows += [(200, rows[3][1].upper() + "!"), (201, rows[100][1])]
    return rows


def test_equals_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert found(docs) == brute(docs)


@pytest.mark.parametrize("small, block", [(8, 512), (2, 16)])
def test_large_groups_equal_all_pairs(documents, monkeypatch, small, block):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", block)
    docs = documents(crowd())
    got = found(docs)
    assert got == brute(docs)
    assert len({got[i] for i in range(60)}) == 1 and got[200] == got[3] and len({got[100 + i] for i in range(60)}) >= 59


def test_edges(documents, spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "one two"), (7, "One, TWO"), (8, "two one"), (9, long), (10, long + " more"), (11, "q r s t u v"), (11, "q r s t u v"), (None, "one two"), (12, "...")]
    docs = documents(rows)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (3, False), 5: (5, True), 12: (5, False), 6: (6, True), 7: (6, False), 8: (8, True), 9: (9, True), 10: (9, False), 11: (11, True), None: (None, True)}
    stay = N.deduplicated(docs)
    assert stay.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 2, 3, 5, 6, 8, 9, 11]
    none = docs.limit(0)
    assert N.near_duplicates(none).count() == 0 and N.deduplicated(none).count() == 0


def test_document_frequency_lowers_a_weight(documents):
    docs = documents([(i, f"a common beginning of all texts then x{i} y{i} z{i} u{i} v{i}") for i in range(50)])
    sampler = N.Sampler(N.idf_codes(docs, "text", 16))
    _, key, tf = N.shingles(Words(pa.array(["a common beginning of all", "x7 y7 z7 u7 v7"])))
    common, rare = sampler.weights(key, tf)
    assert 1.0 <= common < rare <= 1 + 1 / 8


def test_sample_collisions_follow_weighted_similarity(documents):
    r = random.Random(2)
    a = words(r, 400)
    b = a[:300] + words(r, 100)
    sampler = N.Sampler(N.idf_codes(documents([(1, " ".join(a)), (2, " ".join(b))]), "text", 16))
    row, key, tf = N.shingles(Words(pa.array([" ".join(a), " ".join(b)])))
    w = sampler.weights(key, tf)
    sim = N.jaccard(key[row == 0], w[row == 0], w[row == 0].sum(), key[row == 1], w[row == 1], w[row == 1].sum())
    _, _, short, total = sampler.bands(row, key, tf)
    assert abs((short[0] == short[1]).mean() - sim) < 0.2 and abs(total[0] - w[row == 0].sum()) < 1e-9


def test_components(spark):
    from quire.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
