"""The learnt embedding against plain numpy, and as a retriever of benchmark passages."""

import math
import random
import re
from collections import Counter

import numpy as np
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from quire.functions import vectors as V
from quire.operators import cooccurrence as W
from quire.operators import embedding as E

TOPICS = [["river", "boat", "water", "fish"], ["Bread", "oven", "flour", "yeast"], ["court", "judge", "law", "trial"]]


def texts(n=240):
    r = random.Random(6)
    return [" ".join(r.choice(TOPICS[i % 3] + ["the", "and"]) for _ in range(30)) for i in range(n)] + [None, "", "...", "rare word"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, word string")


def plain_matrix(rows, words, window):
    number, n = {w: k for k, w in enumerate(words)}, np.zeros((len(words), len(words)))
    for t in rows:
        toks = re.findall(r"[^\W_]+", (t or "").lower())
        for a in range(len(toks)):
            for b in range(a + 1, min(a + window + 1, len(toks))):
                if toks[a] in number and toks[b] in number:
                    i, j = number[toks[a]], number[toks[b]]
                    n[i, j] += 1
                    n[j, i] += 1
    s = n.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.log(n * n.sum() / np.outer(s, s))
    return np.where((n > 0) & (m > 0), m, 0)


def test_matrix_and_subspace_equal_plain_numpy(spark):
    rows = texts()
    df = frame(spark, rows).repartition(4)
    words = [r["word"] for r in W.vocabulary(df, "text").collect()]
    seen = Counter(w for t in rows for w in set(re.findall(r"[^\W_]+", (t or "").lower())))
    assert words == sorted((w for w in seen if seen[w] >= W.MIN_DOCS), key=lambda w: (-seen[w], w)) and "bread" in words
    want, got = plain_matrix(rows, words, W.WINDOW), np.zeros((len(words), len(words)))
    scores = W.ppmi(W.pair_counts(df, "text", words)).cache()
    for r in scores.collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["value"]
    assert np.allclose(got, want)
    values, found = W.leading(scores, len(words), 3, extra=5, tolerance=1e-10, rounds=200)
    all_values, all_vectors = np.linalg.eigh(want)
    top = np.argsort(-np.abs(all_values))[:3]
    assert np.allclose(np.abs(values), np.abs(all_values[top]), rtol=1e-6)
    gap = found @ found.T - all_vectors[:, top] @ all_vectors[:, top].T
    assert np.abs(gap).max() < 1e-4
    assert (np.diff(np.abs(values)) <= 1e-9).all()  # leading parts first


def test_topics_part_and_leading_components_do_most(spark):
    p = W.learnt_provider(frame(spark, texts()), dims=8)
    asked = p.embed(["boat on water", "oven and flour", "judge in court", "unknown zz", None], E.QUERY_TASK)
    assert not asked[3].any() and not asked[4].any()
    docs = p.embed(["fish river", "yeast bread", "law trial"], E.DOCUMENT_TASK)
    for width in (8, 4):
        a, b = (x[:, :width] / np.linalg.norm(x[:, :width], axis=1, keepdims=True) for x in (asked[:3], docs))
        assert ((a @ b.T).argmax(1) == np.arange(3)).all()
    out = E.embed_texts(frame(spark, ["boat", None, "zzz"]), "text", p).select("doc_id", "embed_error", F.size("embedding").alias("n"), V.norm("embedding").alias("norm")).orderBy("doc_id").collect()
    assert out[0]["n"] == 8 and abs(out[0]["norm"] - 1) < 1e-6 and out[1]["embed_error"] and out[2]["embed_error"]


def test_empty_corpus(spark):
    p = W.learnt_provider(frame(spark, []), dims=5)
    assert p.dims == 5 and not p.embed(["a"], E.DOCUMENT_TASK).any()
    assert W.pair_counts(frame(spark, [None, ""]), "text", ["a"]).count() == 0


def test_finds_benchmark_passages_better_than_hashing(spark):
    """Mean reciprocal rank of the documents that share 13 words in a row with a benchmark text, at sf0.01."""
    docs, bench = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    items = [r["text"] for r in bench.orderBy("item_id").collect()]
    toks = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[a : a + 13]) for a in range(len(w) - 12)}
    held = [grams(toks(t)) for _, t in rows]
    relevant = {i: [j for j, h in enumerate(held) if h & grams(toks(t))] for i, t in enumerate(items)}

    def score(provider):
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = unit(provider.embed(items, E.QUERY_TASK)) @ unit(provider.embed([t for _, t in rows], E.DOCUMENT_TASK)).T
        rank = lambda i: 1 + min((s[i] > s[i, j]).sum() for j in relevant[i])
        return np.mean([1 / rank(i) for i in relevant if relevant[i]])

    learnt, hashed = score(W.learnt_provider(docs, size=16_384)), score(E.HashingProvider(64))
    assert math.isfinite(learnt) and learnt > hashed


def test_pairs_do_not_reach_into_the_next_text(spark):
    df = spark.createDataFrame([("a b",), ("b a a",), (None,), ("",), ("c",)], "text string").coalesce(1)
    got = {(r["i"], r["j"]): r["n"] for r in W.pair_counts(df, "text", ["a", "b", "c"]).collect()}
    assert got == {(0, 1): 3, (0, 0): 1}


def test_learnt_retrieval_embeds_each_document_once(spark, monkeypatch):
    from quire.plans import q_index
    from quire.sources.tables import read_table

    counted = spark.sparkContext.accumulator(0)

    class Counting(E.HashingProvider):
        def embed(self, texts, task_type):
            if task_type == E.DOCUMENT_TASK:
                counted.add(len(texts))
            return super().embed(texts, task_type)

    monkeypatch.setattr(q_index.W, "learnt_provider", lambda docs: Counting(64))
    assert q_index.learnt_retrieval(spark, SF_SMALL).count()
    assert counted.value == read_table(spark, SF_SMALL, "documents").count()
