"""Registered retrieval and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import vectors as V
from quire.operators import retrieval as R
from quire.plans import oracle as O
from quire.plans.registry import register, round_doubles
from quire.operators import quantized as Z
from quire.plans.fixtures import chunk_store, query_vectors, stated_queries
from quire.sources.tables import read_table
from quire.functions.text import WS

QUERY_VEC_ID = 0
TOP_K = 5
FILTER_FILE = "file3"
FILTER_STRATEGY = "paragraph"
TRUNC_DIMS = 32


def _query_vector(spark, sf_dir, vec_id=QUERY_VEC_ID):
    row = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


_Q_CTE = f"WITH cs AS ({O.chunk_store()}), qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {QUERY_VEC_ID})"


@register(
    "cosine_similarity",
    f"""{_Q_CTE}
SELECT cs.id, round({O.cosine('cs.embedding', 'qv.v')}, 6) AS similarity FROM cs, qv""",
)
def cosine_similarity(spark, sf_dir):
    q = F.array(*[F.lit(x) for x in _query_vector(spark, sf_dir)])
    cs = chunk_store(spark, sf_dir)
    return round_doubles(cs.select("id", V.cosine_similarity("embedding", q).alias("similarity")))


_TOPK_COLS = "id, chunk_text, filename, split_strategy, chunk_index, created_at"


@register(
    "search_topk",
    f"""{_Q_CTE}
SELECT {_TOPK_COLS}, round(sim, 6) AS similarity FROM (
  SELECT cs.*, {O.cosine('cs.embedding', 'qv.v')} AS sim FROM cs, qv)
ORDER BY sim DESC NULLS LAST, id LIMIT {TOP_K}""",
)
def search_topk(spark, sf_dir):
    return round_doubles(R.search_topk(chunk_store(spark, sf_dir), _query_vector(spark, sf_dir), TOP_K))


@register(
    "search_filtered",
    f"""{_Q_CTE}
SELECT {_TOPK_COLS}, round(sim, 6) AS similarity FROM (
  SELECT cs.*, {O.cosine('cs.embedding', 'qv.v')} AS sim FROM cs, qv
  WHERE filename = '{FILTER_FILE}' AND split_strategy = '{FILTER_STRATEGY}')
ORDER BY sim DESC NULLS LAST, id LIMIT {TOP_K}""",
)
def search_filtered(spark, sf_dir):
    return round_doubles(
        R.search_topk(
            chunk_store(spark, sf_dir), _query_vector(spark, sf_dir), TOP_K, filename=FILTER_FILE,
            split_strategy=FILTER_STRATEGY,
        )
    )


_BATCH_SQL = f"""WITH cs AS ({O.chunk_store()}),
qs AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings),
scored AS (SELECT qs.query_id, cs.id, {O.cosine('cs.embedding', 'qs.v')} AS sim FROM qs, cs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(sim, 6) AS similarity FROM ranked WHERE rank <= {TOP_K}"""


@register("search_batch", _BATCH_SQL)
def search_batch(spark, sf_dir):
    """Every stored vector is a query against all of them."""
    return round_doubles(R.search_batch(chunk_store(spark, sf_dir), query_vectors(spark, sf_dir), TOP_K, many=True))


def _approx(spark, sf_dir, queries, probe=None):
    """The stored quantised index over all vectors, searched with ``queries``; ``probe`` is a share of the cells."""
    from quire.session import shared_dir

    cs, root = chunk_store(spark, sf_dir), shared_dir(spark, "quantized")
    index = Z.fit(cs)
    Z.write_index(cs, index, root)
    return cs, Z.search_index(spark, root, index, queries, TOP_K, n_probe=probe and max(1, round(probe * len(index.centers))), unique=False)


@register("search_approx", _BATCH_SQL)
def search_approx(spark, sf_dir):
    """Every stored vector is a query: codes of all cells by look-up, CANDIDATES full vectors a query."""
    return round_doubles(_approx(spark, sf_dir, query_vectors(spark, sf_dir))[1])


@register("search_approx_recall")
def search_approx_recall(spark, sf_dir):
    """Recall of each stated query with three quarters of the cells (no SQL: cells and codes are learnt)."""
    cs, found = _approx(spark, sf_dir, stated_queries(spark, sf_dir), probe=0.75)
    return round_doubles(R.recall_at_k(found, R.search_batch(cs, stated_queries(spark, sf_dir), TOP_K)))


@register(
    "rank_results",
    f"""{_Q_CTE},
top AS (SELECT cs.*, {O.cosine('cs.embedding', 'qv.v')} AS sim FROM cs, qv ORDER BY sim DESC NULLS LAST, id LIMIT {TOP_K}),
c AS (SELECT *, regexp_replace(regexp_replace(chunk_text, '{WS}+', ' ', 'g'), '\\A | \\z', '', 'g') AS col FROM top)
SELECT CAST(row_number() OVER (ORDER BY sim DESC NULLS LAST, id) AS INTEGER) AS rank,
       printf('%.4f', sim) AS similarity_text, id, filename, split_strategy, chunk_index,
       strftime(created_at, '%Y-%m-%d %H:%M') AS created_text,
       CASE WHEN length(col) <= 340 THEN col
            ELSE regexp_extract(left(col, 337), '(?s)^(.*) ', 1) || ' ...' END AS preview
FROM c""",
)
def rank_results(spark, sf_dir):
    top = R.search_topk(chunk_store(spark, sf_dir), _query_vector(spark, sf_dir), TOP_K)
    return R.rank_results(top)


@register(
    "diagnose_empty",
    f"""WITH cs AS ({O.chunk_store()})
SELECT count(*) AS total_indexed, count(*) FILTER (WHERE filename = 'file99') AS matched,
       CASE WHEN count(*) FILTER (WHERE filename = 'file99') > 0 THEN 'ok'
            WHEN count(*) = 0 THEN 'No results: the index is empty.'
            ELSE 'No results matching filename=file99. The index holds ' || format('{{:,}}', count(*))
                 || ' chunks -- try a broader query or remove the filters.' END AS message
FROM cs""",
)
def diagnose_empty(spark, sf_dir):
    return R.diagnose_empty(chunk_store(spark, sf_dir), filename="file99")


@register(
    "validate_query",
    """SELECT item_id, CAST(item_id % 7 AS BIGINT) - 1 AS top_k,
       CASE WHEN item_id % 5 = 0 OR length(trim(text)) = 0 THEN 'Error: --query must not be empty.'
            WHEN item_id % 7 - 1 <= 0 THEN 'Error: --top-k must be greater than 0.' END AS error,
       (item_id % 5 <> 0 AND length(trim(text)) > 0 AND item_id % 7 - 1 > 0) AS ok
FROM benchmark""",
)
def validate_query(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark")
    reqs = bench.select(
        "item_id",
        F.when(F.col("item_id") % 5 == 0, F.lit("   ")).otherwise(F.col("text")).alias("query"),
        (F.col("item_id") % 7 - 1).alias("top_k"),
    )
    return R.validate_queries(reqs).select("item_id", "top_k", "error", "ok")


@register(
    "index_summary",
    f"""WITH cs AS ({O.chunk_store()})
SELECT filename, split_strategy, count(*) AS n_chunks, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims,
       first(left(chunk_text, 42) ORDER BY chunk_index, id) AS first_preview
FROM cs GROUP BY filename, split_strategy""",
)
def index_summary(spark, sf_dir):
    return R.index_summary(chunk_store(spark, sf_dir))


@register(
    "truncate_dims",
    f"""SELECT vec_id, len(list_slice(embedding, 1, {TRUNC_DIMS})) AS dims,
       array_to_string(list_transform(list_slice(embedding, 1, {TRUNC_DIMS}), lambda x: CAST(CAST(x AS DOUBLE) AS DECIMAL(18,6))::VARCHAR), ',') AS vector
FROM embeddings""",
)
def truncate_dims(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    t = V.truncate_dims("embedding", TRUNC_DIMS)
    return emb.select("vec_id", F.size(t).alias("dims"), V.vector_text(t).alias("vector"))


@register(
    "l2_normalize",
    f"""WITH t AS (SELECT vec_id, embedding AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) AS nrm FROM t),
u AS (SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: CAST(CAST(x AS DOUBLE) / nrm AS FLOAT)) END AS u FROM n)
SELECT vec_id, round(sqrt(list_dot_product(u::DOUBLE[], u::DOUBLE[])), 6) AS norm,
       array_to_string(list_transform(u, lambda x: CAST(CAST(x AS DOUBLE) AS DECIMAL(18,6))::VARCHAR), ',') AS vector
FROM u""",
)
def l2_normalize(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    u = emb.select("vec_id", V.l2_normalize("embedding").alias("u"))
    return round_doubles(u.select("vec_id", V.norm("u").alias("norm"), V.vector_text("u").alias("vector")))
