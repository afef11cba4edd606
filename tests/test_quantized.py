"""The quantised index: recall against brute force, scores against decoded vectors, defined results."""

import numpy as np
from conftest import SF_MID
from pyspark.sql import functions as F

from quire.operators import quantized as Z
from quire.operators import retrieval as R
from quire.plans.fixtures import chunk_store, query_vectors, stated_queries
from quire.session import shared_dir


def index_of(spark, cs, **options):
    z, root = Z.fit(cs, **options), shared_dir(spark, "test-quantized")
    Z.write_index(cs, z, root)
    return z, root


def test_recall_at_a_small_share_of_the_vectors(spark):
    """Half of the given vectors' cells and 100 of 2,000 full vectors a query."""
    sf = "/root/testdata/sf0.1"
    cs, qs = chunk_store(spark, sf), stated_queries(spark, sf)
    z, root = index_of(spark, cs)
    assert Z.CANDIDATES / cs.count() <= 0.05
    exact = R.search_batch(cs, qs, 5)
    recall = {}
    for share in (0.25, 0.75, 1):
        found = Z.search_index(spark, root, z, qs, 5, n_probe=max(1, round(share * len(z.centers))))
        recall[share] = R.recall_at_k(found, exact).agg(F.avg("recall")).first()[0]
    assert recall[0.25] <= recall[0.75] <= recall[1] + 1e-9
    assert recall[0.75] >= 0.9 and recall[1] >= 0.97


def test_all_codes_and_candidates_equal_the_exact_search(spark):
    cs, qs = chunk_store(spark, SF_MID), query_vectors(spark, SF_MID).where("query_id % 25 = 0")
    z, root = index_of(spark, cs)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in Z.search_index(spark, root, z, qs, 5, candidates=500).collect())
    assert got == sorted((r["query_id"], r["rank"], r["id"]) for r in R.search_batch(cs, qs, 5).collect())


def test_look_up_scores_equal_products_with_decoded_vectors():
    import pyarrow as pa

    g = np.random.default_rng(2)
    x = g.normal(size=(300, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = Z.Quantizer(10, x[:7].copy(), g.normal(size=(4, 16, 3)) * 0.2)
    cell, code = z.coded(x)
    decoded = z.padded(z.centers[cell]) + np.concatenate([z.books[m][code[:, m]] for m in range(4)], 1)

    class Shared:
        value = z

    q = x[20:25]
    left = pa.table({"query_id": np.arange(5), "unit": list(q), "floor": np.full(5, -np.inf)})
    right = pa.table({"id": np.arange(300), "cell": cell, "code": [c.tobytes() for c in code]})
    out = Z._looked_up(Shared, 300)(left, right).to_pandas()
    want = z.padded(q) @ decoded.T
    assert len(out) == 1500
    assert np.allclose(out.score, want[out.query_id, out.id])


def test_defined_results(spark):
    schema = "id long, embedding array<float>"
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(90, None), (91, [0.0] * 3), (92, [1.0]), (93, [None, 1.0, 1.0]), (94, [float("nan")] * 3)]
    cs = spark.createDataFrame(rows, schema)
    z, root = index_of(spark, cs)
    qs = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0] * 3), (4, [1.0])], "query_id long, query array<float>")
    out = Z.search_index(spark, root, z, qs, 5, candidates=40).collect()
    assert {r["query_id"] for r in out} == {1} and all(r["id"] < 40 for r in out) and len(out) == 5
    empty = spark.createDataFrame([], schema)
    z, root = index_of(spark, empty)
    assert Z.search_index(spark, root, z, qs, 5).collect() == []


def test_every_stored_vector_is_a_query(spark, tmp_path):
    """The registered query over own rows: ids not divisible by 50, a repeated row, a null vector."""
    import __spark_entry__ as E

    x = np.random.default_rng(5).normal(size=(90, 8)).astype(np.float32)
    rows = [(101 + i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows + rows[:1] + [(300, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    key = lambda name: sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in E.queries()[name](spark, str(tmp_path)).where("query_id < 300").collect())
    got = key("search_approx")
    assert {q for q, *_ in got} == {i for i, *_ in rows} and got == key("search_batch")
    assert "% 50" not in E.oracle_sql()["search_approx"] + E.oracle_sql()["search_batch"]


def test_look_up_keeps_the_best_codes_by_score_and_id():
    """More rows than a tile, many equal codes, cells below the floor."""
    import pyarrow as pa

    g = np.random.default_rng(3)
    z = Z.Quantizer(8, g.normal(size=(5, 8)), g.normal(size=(4, 6, 2)))
    n = 5000
    cell, code = g.integers(0, 5, n), g.integers(0, 2, (n, 4)).astype(np.uint8)

    class Shared:
        value = z

    ids, q = g.permutation(n), g.normal(size=(3, 8))
    floor = np.array([-np.inf, np.sort(q[1] @ z.centers.T)[2], np.inf])
    left = pa.table({"query_id": np.arange(3), "unit": list(q), "floor": floor})
    right = pa.table({"id": ids, "cell": cell, "code": [c.tobytes() for c in code]})
    out = Z._looked_up(Shared, 40)(left, right).to_pandas()
    for j in range(3):
        base = z.centers @ q[j]
        score = np.where(base >= floor[j], base, -np.inf)[cell]
        for m in range(4):
            score = score + (z.books[m] @ q[j, 2 * m : 2 * m + 2])[code[:, m]]
        best = np.lexsort((ids, -np.round(score, 12)))[:40]
        assert list(out.id[out.query_id == j]) == (list(ids[best]) if j < 2 else [])
