"""Retrieval: top-k equals the head of the full ordering; batch kNN equals a
numpy brute force; IVF recall; empty-result diagnosis; query validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.functions import vectors as V
from quire.operators import retrieval as R
from quire.plans.fixtures import chunk_store, query_vectors


def _brute(spark):
    cs = chunk_store(spark, SF_SMALL).select("id", "embedding").collect()
    ids = np.array([r["id"] for r in cs])
    X = np.array([r["embedding"] for r in cs], dtype=np.float64)
    return ids, X


def test_topk_is_head_of_full_order(spark):
    cs = chunk_store(spark, SF_SMALL)
    q = cs.where("id = 3").first()["embedding"]
    top = [r["id"] for r in R.search_topk(cs, q, 7).collect()]
    full = cs.select("id", V.cosine_similarity("embedding", F.array(*[F.lit(float(x)) for x in q])).alias("s"))
    order = [r["id"] for r in full.orderBy(F.desc("s"), "id").collect()]
    assert top == order[:7]
    assert top[0] == 3


def test_filters_applied(spark):
    cs = chunk_store(spark, SF_SMALL)
    q = cs.first()["embedding"]
    rows = R.search_topk(cs, q, 5, filename="file2", split_strategy="sentence").collect()
    assert rows and all(r["filename"] == "file2" and r["split_strategy"] == "sentence" for r in rows)


def test_batch_equals_brute_force(spark):
    ids, X = _brute(spark)
    qs = query_vectors(spark, SF_SMALL).where("query_id % 25 = 0")  # a sample of queries keeps the test quick
    got = R.search_batch(chunk_store(spark, SF_SMALL), qs, 4).collect()
    Q = {r["query_id"]: np.array(r["query"], dtype=np.float64) for r in qs.collect()}
    for qid, qv in Q.items():
        sims = X @ qv / (np.linalg.norm(X, axis=1) * np.linalg.norm(qv))
        order = np.lexsort((ids, -sims))[:4]
        have = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == qid)
        assert [i for _, i in have] == list(ids[order])


def test_batch_of_many_blocks_equals_few(spark, monkeypatch):
    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id < 40")
    one = sorted(tuple(r) for r in R.search_batch(cs, qs, 3).collect())
    monkeypatch.setattr(R, "MERGED", 3)
    many = sorted(tuple(r) for r in R.search_batch(cs, qs, 3, query_block=10, chunk_block=9).collect())
    assert [(a, b, c) for a, b, c, _ in one] == [(a, b, c) for a, b, c, _ in many]


def test_ivf_recall(spark):
    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id < 30")
    approx = R.search_approx(cs, qs, 5, n_cells=4, n_probe=4)  # probing every cell is exact
    exact = R.search_batch(cs, qs, 5)
    rec = [r["recall"] for r in R.recall_at_k(approx, exact).collect()]
    assert rec and min(rec) == 1.0


def test_diagnose_empty(spark):
    cs = chunk_store(spark, SF_SMALL)
    msg = R.diagnose_empty(cs, filename="nope").first()["message"]
    assert msg.startswith("No results matching filename=nope. The index holds 500 chunks")
    empty = cs.limit(0)
    assert R.diagnose_empty(empty).first()["message"] == "No results: the index is empty."


def test_validate_query():
    with pytest.raises(ValueError, match="must not be empty"):
        R.validate_query("  ", 5)
    with pytest.raises(ValueError, match="greater than 0"):
        R.validate_query("login issue", 0)


def test_rank_results_preview(spark):
    long = " ".join(["word"] * 200)
    df = spark.createDataFrame([(1, long, "f", "fixed", 0, 0.123456)],
                               "id long, chunk_text string, filename string, split_strategy string, chunk_index int, similarity double")
    df = df.withColumn("created_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    r = R.rank_results(df).first()
    assert r["rank"] == 1 and r["similarity_text"] == "0.1235" and r["created_text"] == "2026-01-02 03:04"
    assert r["preview"].endswith(" ...") and len(r["preview"]) <= 340


def test_embedding_retry_contract():
    from quire.operators import embedding as E

    class Flaky:
        dims, name = 4, "flaky"

        def __init__(self, fails, wrong=False):
            self.fails, self.wrong, self.calls = fails, wrong, 0

        def embed(self, texts, task_type):
            self.calls += 1
            if self.calls <= self.fails:
                raise RuntimeError("boom")
            return np.ones((len(texts) + (1 if self.wrong else 0), 4))

    waits = []
    p = Flaky(2)
    assert E.embed_batch(p, ["a", "b"], E.DOCUMENT_TASK, 0, sleep=waits.append).shape == (2, 4)
    assert waits == [2.0, 4.0] and p.calls == 3
    with pytest.raises(E.EmbeddingError, match="failed after 3 attempts"):
        E.embed_batch(Flaky(5), ["a"], E.DOCUMENT_TASK, 100, sleep=lambda s: None)
    wrong = Flaky(0, wrong=True)
    with pytest.raises(E.EmbeddingError, match=r"returned 2 embeddings for 1 inputs \(batch starting at chunk 7\)"):
        E.embed_batch(wrong, ["a"], E.DOCUMENT_TASK, 7, sleep=lambda s: None)
    assert wrong.calls == 1
    with pytest.raises(E.EmbeddingError, match="Nothing to embed"):
        E.embed_batch(wrong, [], E.DOCUMENT_TASK, 0)


def test_null_zero_and_wide_vectors_rank_alike_in_both_searches(spark):
    rows = [(1, [1.0] * 300), (2, None), (3, [0.0] * 300), (4, [1.0] * 299 + [0.5])]
    cs = spark.createDataFrame([(i, "t", v, "f", "fixed", 0) for i, v in rows], "id long, chunk_text string, embedding array<float>, filename string, split_strategy string, chunk_index int")
    cs = cs.withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    one = [(r["id"], r["similarity"] is None) for r in R.search_topk(cs, [1.0] * 300, 4).collect()]
    qs = spark.createDataFrame([(7, [1.0] * 300)], "query_id long, query array<float>")
    many = [(r["id"], r["similarity"] is None) for r in R.search_batch(cs, qs, 4).orderBy("rank").collect()]
    assert one == many == [(1, False), (4, False), (2, True), (3, True)]


def test_repeated_query_ids_are_refused_at_any_size(spark):
    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id < 2")
    with pytest.raises(ValueError, match="unique"):
        R.search_batch(cs, qs.unionByName(qs), 3)


def test_dense_topk_kernel_ties_by_id():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    X = np.vstack([base, base[[0, 0, 1]]])  # exact duplicates create boundary ties
    ids = np.array([9, 3, 7, 1, 5, 8, 2, 6, 4], np.int64)
    Q = base[[0, 1, 2]]
    best = R._DenseTopK(len(Q), 2)
    for lo in range(0, len(X), 4):  # several Arrow-sized batches
        best.offer_all(ids[lo:lo + 4], R._cosine(X[lo:lo + 4], Q))
    S = R._cosine(X, Q)
    for j in range(len(Q)):
        want = set(ids[np.lexsort((ids, -S[:, j]))[:2]])
        assert set(best.ids[:, j]) == want


def test_ivf_recall_grows_with_probes(spark):
    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id % 5 = 0")
    exact = R.search_batch(cs, qs, 5)
    model = R.build_ivf(cs, n_cells=8)
    rec = []
    for probe in (1, 4, 8):
        ap = R.search_approx(cs, qs, 5, n_cells=8, n_probe=probe, model=model)
        rec.append(R.recall_at_k(ap, exact).agg(F.avg("recall")).first()[0])
    assert rec[0] <= rec[1] <= rec[2] == 1.0


def test_l2_normalize_gives_unit_vectors(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    u = emb.select(V.l2_normalize(V.truncate_dims("embedding", 16)).alias("u"))
    norms = [r["n"] for r in u.select(V.norm("u").alias("n")).collect()]
    assert norms and max(abs(n - 1.0) for n in norms) < 1e-6  # float32 components, double sums
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    assert zero.select(V.l2_normalize("v").alias("u")).first()["u"] is None


PREVIEWS = [
    ("a  b\n c", "a b c"),
    ("x" * 400, "..."),
    ("ab " * 150, "ab " * 111 + "ab ..."),
    ("well-" * 100, "well-" * 67 + " ..."),
    ("w" * 340, "w" * 340),
]


def test_preview_golden(spark):
    df = spark.createDataFrame([(i, t, "f", "fixed", 0, 1.0 - i / 10) for i, (t, _) in enumerate(PREVIEWS)], "id long, chunk_text string, filename string, split_strategy string, chunk_index int, similarity double")
    rows = R.rank_results(df.withColumn("created_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))).orderBy("rank").collect()
    assert [r["preview"] for r in rows] == [p for _, p in PREVIEWS]


def test_stored_ivf_reads_probed_cells_and_matches_on_the_fly(spark):
    import contextlib
    import io

    from quire.session import shared_dir

    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id % 10 = 0")
    model = R.build_ivf(cs, n_cells=8)
    root = shared_dir(spark, "test-ivf")
    R.write_ivf_index(cs, model, root)
    stored = sorted(tuple(r) for r in R.search_ivf_index(spark, root, qs, 5, n_probe=2).collect())
    live = sorted(tuple(r) for r in R.search_approx(cs, qs, 5, n_probe=2, model=model).collect())
    assert [(a, b, c) for a, b, c, _ in stored] == [(a, b, c) for a, b, c, _ in live]
    one = query_vectors(spark, SF_SMALL).where("query_id = 0")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        R.search_ivf_index(spark, root, one, 5, n_probe=1).explain()
    assert "PartitionFilters: [isnotnull(cell" in buf.getvalue() and "cell#" in buf.getvalue()


def test_query_and_document_space_must_match():
    from quire.operators import embedding as E

    E.check_same_space(E.HashingProvider(64), E.HashingProvider(64))
    with pytest.raises(E.EmbeddingError, match="do not match"):
        E.check_same_space(E.HashingProvider(64), E.HashingProvider(32))


def test_a_pass_is_written_before_the_next_is_fetched(spark, monkeypatch):
    """The driver holds one pass of queries at a time; the result is no union of passes."""
    cs = chunk_store(spark, SF_SMALL)
    qs = query_vectors(spark, SF_SMALL).where("query_id < 40")
    live, most, share = set(), [0], spark.sparkContext.broadcast

    def watched(value):
        b = share(value)
        live.add(id(b))
        most[0] = max(most[0], len(live))
        end = b.destroy
        b.destroy = lambda *a, **k: (live.discard(id(b)), end(*a, **k))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", watched)
    small = 64 * 8 * 10  # ten queries a pass
    found = [R.search_approx(cs, qs, 3, n_cells=4, n_probe=4, max_broadcast_bytes=small)]
    assert most[0] == 1
    monkeypatch.undo()
    one = sorted(tuple(r)[:3] for r in R.search_batch(cs, qs, 3).collect())
    for f in found:
        assert "Union" not in f._jdf.queryExecution().toString()
        assert sorted(tuple(r)[:3] for r in f.collect()) == one


def test_null_and_odd_queries_have_null_similarities(spark):
    cs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (4, [1.0, 2.0, 3.0]), (5, [None, 1.0])], "id long, embedding array<float>")
    qs = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.1]), (4, [1.0, 2.0, 3.0]), (5, [])], "query_id long, query array<float>")
    got = {}
    for r in R.search_batch(cs, qs, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], None if r["similarity"] is None else round(r["similarity"], 3)))
    assert got == {1: [(1, None), (2, None)], 2: [(1, None), (2, None)], 3: [(3, 0.995), (1, 0.1)], 4: [(4, 1.0), (1, None)], 5: [(1, None), (2, None)]}
    ivf = R.search_approx(cs.where("id in (1, 3)"), qs.where("query_id < 4"), 2, n_cells=2, n_probe=2)
    assert {r["query_id"] for r in ivf.collect()} == {1, 2, 3}


def test_batch_has_no_driver_hop(spark):
    cs = chunk_store(spark, SF_SMALL)
    plan = R.search_batch(cs, query_vectors(spark, SF_SMALL), 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan and "CartesianProduct" not in plan


def test_a_longer_result_than_can_be_ranked_is_refused(spark):
    df = spark.createDataFrame([(i, "t", "f", "fixed", 0, 0.5) for i in range(4)], "id long, chunk_text string, filename string, split_strategy string, chunk_index int, similarity double")
    df = df.withColumn("created_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    assert R.rank_results(df, most=4).count() == 4
    with pytest.raises(Exception, match="at most 3 rows"):
        R.rank_results(df, most=3).collect()


def _embeddings(spark, root, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def test_every_stored_vector_is_a_query(spark, tmp_path):
    """Row by row against brute force, ids not divisible by 50 and repeated ids included."""
    import __spark_entry__ as E

    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[40:50] = x[7]  # equal vectors: ties by id
    rows = [(101 + i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(101, [float(c) for c in x[0]], 0), (300, None, 0)]
    got = {}
    for r in E.queries()["search_batch"](spark, _embeddings(spark, tmp_path, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    assert set(got) == {i for i, _, _ in rows}
    assert [(i, s) for _, i, s in got[300]] == [(101, None)] * 2 + [(102, None), (103, None), (104, None)]
    assert [i for _, i, _ in got[101]][:4] == [101] * 4  # two rows by two rows
    assert [i for _, i, _ in got[145]] == [108, 141, 142, 143, 144]
    full, ids = x.astype(np.float64), np.arange(101, 161)
    full, ids = np.vstack([full, full[:1]]), np.append(ids, 101)
    for q in range(1, 60):
        s = (full * full[q]).sum(1) / np.sqrt((full * full).sum(1) * (full[q] * full[q]).sum())
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        assert [i for _, i, _ in got[101 + q]] == list(ids[best])


@pytest.mark.parametrize("n, dims", [(3, 4), (700, 6), (2600, 33)])
def test_best_pairs_equal_brute_force(n, dims):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, dims)), 1)  # many near and some equal rows
    x[n // 2 :: 7] = x[0]
    x[1] = 0
    x[2, 0] = np.nan
    order = rng.permutation(n)
    q = np.vstack([x[: min(n, 1100)], np.zeros((1, dims)), 1e-3 * x[:1]])
    got = [np.concatenate(c) for c in zip(*R._best_pairs(x, order, q, 5))]
    for j in range(0, len(q), 9 if n > 3 else 1):
        with np.errstate(invalid="ignore"):
            s = R.exact_cosine(x, np.repeat(q[j : j + 1], n, 0))
        want = np.lexsort((order, np.where(np.isfinite(s), -s, np.inf)))[:5]
        rows = got[1][got[0] == j]
        assert list(rows) == list(want) and np.array_equal(got[2][got[0] == j], s[want], equal_nan=True)
