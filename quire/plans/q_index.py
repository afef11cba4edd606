"""Registered embedding, store and flagship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import vectors as V
from quire.operators import chunking as C
from quire.operators import cooccurrence as W
from quire.operators import embedding as E
from quire.operators import retrieval as R
from quire.plans import indexing as I
from quire.plans import oracle as O
from quire.plans.registry import register, round_doubles
from quire.plans.fixtures import chunk_store
from quire.plans.q_chunking import _ALL_SQL, _PREP, SIZE, OVERLAP, all_chunks, prepared
from quire.sources import store as S
from quire.sources.tables import read_table

DIMS = I.DIMS


def _bucket_sql(tok: str) -> str:
    return f"CAST(CAST(('0x' || left(md5({tok}), 8)) AS BIGINT) % {DIMS} AS INTEGER)"


def hashed_vectors_ctes(src: str, keys: list[str], text: str, out: str) -> str:
    """``src(keys, text)`` -> ``out(keys, n, vec FLOAT[], vector VARCHAR)``."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{c} = b.{c}" for c in keys)
    ck = ", ".join(f"c.{c}" for c in keys)
    split = O.q(E.TOKEN_SPLIT)
    return f"""
{out}_tok AS (SELECT {k}, unnest(list_filter(string_split_regex(lower({text}), {split}), lambda t: t <> '')) AS tok FROM {src}),
{out}_b AS (SELECT {k}, {_bucket_sql('tok')} AS bucket, count(*) AS cnt FROM {out}_tok GROUP BY ALL),
{out}_d AS (SELECT {ck}, r.i AS bucket, coalesce(b.cnt, 0)::DOUBLE AS cnt
            FROM {src} c CROSS JOIN range({DIMS}) r(i) LEFT JOIN {out}_b b ON {on} AND b.bucket = r.i),
{out}_n AS (SELECT {k}, sqrt(sum(cnt * cnt)) AS n FROM {out}_d GROUP BY ALL),
{out} AS (
  SELECT {', '.join('d.' + c for c in keys)}, max(n.n) AS n,
         CASE WHEN max(n.n) > 0 THEN list(CAST(d.cnt / n.n AS FLOAT) ORDER BY d.bucket) END AS vec,
         CASE WHEN max(n.n) > 0 THEN string_agg(CAST(CAST(CAST(d.cnt / n.n AS FLOAT) AS DOUBLE) AS DECIMAL(18,6))::VARCHAR, ',' ORDER BY d.bucket) END AS vector
  FROM {out}_d d JOIN {out}_n n USING ({k}) GROUP BY {', '.join('d.' + c for c in keys)})"""


@register(
    "embed_texts",
    f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')},{hashed_vectors_ctes('cp', ['doc_id', 'chunk_index'], 'chunk_text', 'hv')}
SELECT doc_id, chunk_index, n > 0 AS ok, vector FROM hv""",
)
def embed_texts(spark, sf_dir):
    ch = C.chunk_text(prepared(spark, sf_dir), "text", "paragraph", SIZE, OVERLAP, keep=["doc_id"])
    emb = E.embed_texts(ch, "chunk_text", E.HashingProvider(DIMS))
    return emb.select("doc_id", "chunk_index", F.col("embed_error").isNull().alias("ok"), V.vector_text("embedding").alias("vector"))


@register(
    "task_type",
    f"""WITH b AS (SELECT item_id, text FROM benchmark),{hashed_vectors_ctes('b', ['item_id'], 'text', 'hv')}
SELECT item_id, 'RETRIEVAL_QUERY' AS task_type, n > 0 AS ok, vector FROM hv""",
)
def task_type(spark, sf_dir):
    """Queries are embedded with the query task type by the same provider and
    width as documents."""
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    emb = E.embed_texts(bench, "text", E.HashingProvider(DIMS), E.QUERY_TASK)
    return emb.select(
        "item_id", F.lit(E.QUERY_TASK).alias("task_type"), F.col("embed_error").isNull().alias("ok"),
        V.vector_text("embedding").alias("vector"),
    )


@register(
    "assign_batches",
    f"""{_ALL_SQL}
SELECT doc_id, split_strategy, CAST(chunk_index // 100 AS INTEGER) AS batch_no, count(*) AS n_in_batch,
       min(chunk_index) AS batch_offset
FROM allc GROUP BY ALL""",
)
def assign_batches(spark, sf_dir):
    return E.assign_batches(all_chunks(spark, sf_dir))


_VEC_SQL = """SELECT CASE WHEN vec_id % 13 = 0 THEN vec_id + 1000000 ELSE vec_id END AS id,
       CASE WHEN vec_id % 11 = 0 THEN list_slice(embedding, 1, 32) ELSE embedding END AS embedding
FROM embeddings WHERE vec_id % 7 <> 0"""


def _vectors(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 7 != 0)
    return emb.select(
        F.when(F.col("vec_id") % 13 == 0, F.col("vec_id") + 1000000).otherwise(F.col("vec_id")).alias("id"),
        F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
    )


@register(
    "check_vectors",
    f"""WITH cs AS ({O.chunk_store()}), v AS ({_VEC_SQL})
SELECT coalesce(cs.id, v.id) AS id, len(v.embedding) AS width,
       CASE WHEN cs.id IS NULL THEN 'vector_without_chunk' WHEN v.id IS NULL THEN 'chunk_without_vector'
            WHEN len(v.embedding) <> 64 THEN 'wrong_width' ELSE 'ok' END AS status
FROM cs FULL OUTER JOIN v ON cs.id = v.id""",
)
def check_vectors(spark, sf_dir):
    return E.check_vectors(chunk_store(spark, sf_dir), _vectors(spark, sf_dir), 64)


@register(
    "chunk_table_schema",
    f"""WITH cs AS ({O.chunk_store()}), v AS ({_VEC_SQL})
SELECT cs.id, CASE WHEN v.embedding IS NULL THEN 'embedding is null'
                   WHEN len(v.embedding) <> 64 THEN 'embedding width ' || len(v.embedding) || ' <> 64' END AS violation
FROM cs LEFT JOIN v ON cs.id = v.id""",
)
def chunk_table_schema(spark, sf_dir):
    cs = chunk_store(spark, sf_dir).drop("embedding").join(_vectors(spark, sf_dir), "id", "left")
    return S.check_chunks(cs, 64).select("id", "violation")


@register(
    "replace_chunks",
    f"""WITH cs AS ({O.chunk_store()}),
nw AS (SELECT id, 'reindexed ' || chunk_text AS chunk_text, filename, split_strategy, chunk_index FROM cs
       WHERE split_strategy = 'sentence' AND id % 2 = 0)
SELECT id, chunk_text, filename, split_strategy, chunk_index FROM cs
WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.filename = cs.filename AND nw.split_strategy = cs.split_strategy)
UNION ALL SELECT * FROM nw""",
)
def replace_chunks(spark, sf_dir):
    cs = chunk_store(spark, sf_dir).select("id", "chunk_text", "filename", "split_strategy", "chunk_index")
    new = cs.where((F.col("split_strategy") == "sentence") & (F.col("id") % 2 == 0)).withColumn(
        "chunk_text", F.concat(F.lit("reindexed "), F.col("chunk_text"))
    )
    return S.replace_chunks(cs, new)


@register(
    "assign_ids",
    f"""{_ALL_SQL}
SELECT doc_id, split_strategy, chunk_index,
       doc_id * {1 << (S.INDEX_BITS + 2)} + (CASE split_strategy WHEN 'fixed' THEN 0 WHEN 'sentence' THEN 1 ELSE 2 END) * {1 << S.INDEX_BITS}
       + chunk_index AS id
FROM allc""",
)
def assign_ids(spark, sf_dir):
    return S.assign_ids(all_chunks(spark, sf_dir), "doc_id").select("doc_id", "split_strategy", "chunk_index", "id")


@register("count_chunks", f"{_ALL_SQL}\nSELECT count(*) AS n_chunks FROM allc")
def count_chunks(spark, sf_dir):
    return S.count_chunks(all_chunks(spark, sf_dir))


_FLAG_SQL = f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')},{hashed_vectors_ctes('cp', ['doc_id', 'chunk_index'], 'chunk_text', 'hv')},
bq AS (SELECT item_id, text FROM benchmark WHERE item_id = {I.FLAGSHIP_QUERY_ITEM}),{hashed_vectors_ctes('bq', ['item_id'], 'text', 'qv')},
scored AS (
  SELECT cp.doc_id, doc_id * {1 << (S.INDEX_BITS + 2)} + 2 * {1 << S.INDEX_BITS} + cp.chunk_index AS id, cp.chunk_text,
         'doc' || cp.doc_id AS filename, 'paragraph' AS split_strategy, cp.chunk_index,
         {O.cosine('hv.vec', 'qv.vec')} AS sim
  FROM cp JOIN hv USING (doc_id, chunk_index), qv
  WHERE cp.doc_id NOT IN (SELECT doc_id FROM hv WHERE vec IS NULL))
SELECT id, chunk_text, filename, split_strategy, chunk_index, round(sim, 6) AS similarity
FROM scored ORDER BY sim DESC NULLS LAST, id LIMIT 5"""


@register("index_and_search", _FLAG_SQL)
def index_and_search(spark, sf_dir):
    """The flagship (entry) without the wall-clock ``created_at`` column."""
    return round_doubles(I.flagship(spark, sf_dir).drop("created_at"))


_HIT_SQL = _FLAG_SQL.replace(
    "\nSELECT id, chunk_text, filename, split_strategy, chunk_index, round(sim, 6) AS similarity\nFROM scored ORDER BY sim DESC NULLS LAST, id LIMIT 5",
    """,
hits AS (SELECT doc_id, chunk_index AS hit_index FROM scored ORDER BY sim DESC NULLS LAST, id LIMIT 5),
want AS (SELECT doc_id, hit_index, o AS "offset", hit_index + o AS chunk_index FROM hits, (VALUES (-1), (0), (1)) v(o))
SELECT 'doc' || cp.doc_id AS filename, 'paragraph' AS split_strategy, want.hit_index, want."offset", cp.chunk_text
FROM want JOIN cp ON cp.doc_id = want.doc_id AND cp.chunk_index = want.chunk_index""",
)


@register("hit_context", _HIT_SQL)
def hit_context(spark, sf_dir):
    """C14: neighbouring chunks (index -1, 0, +1) of the flagship's top-5 hits. The hits
    (at most k rows) are taken first; then only their documents are chunked."""
    names = ["id", "filename", "split_strategy", "chunk_index"]
    found = I.flagship(spark, sf_dir).select(*names)
    hits = spark.createDataFrame(found.collect(), found.schema)
    docs = read_table(spark, sf_dir, "documents").withColumn("filename", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    docs = docs.join(F.broadcast(hits.select("filename").distinct()), "filename", "left_semi").select("filename", "text")
    chunks = C.chunk_text(I.prepare_documents(docs), "text", "paragraph", SIZE, OVERLAP, keep=["filename"])
    return C.hit_context(hits.drop("id"), chunks)


# A table written, then part of it indexed again - a third of the documents, of
# which one in three is empty now (nothing to write: the old rows stay), one fails to
# embed (quarantined: the old rows stay) and one has shrunk (replaced). The oracle
# chunks each document's surviving version.
FAILS = "zzfailzz"


class FailingProvider(E.HashingProvider):
    """Refuses any request with the marker."""

    def embed(self, texts, task_type):
        if any(FAILS in t for t in texts):
            raise RuntimeError("refused")
        return super().embed(texts, task_type)


def second_version(docs):
    first = F.concat(F.substring_index("text", ".", 1), F.lit("."))
    kind = F.col("doc_id") % 9
    text = F.when(kind == 0, "").when(kind == 3, F.concat(F.lit(FAILS + " "), F.col("text"))).otherwise(first)
    return docs.where(F.col("doc_id") % 3 == 0).withColumn("text", text)


_UPSERT_SQL = (
    f"""{_PREP},{O.chunk_ctes('prep', ['doc_id'], 'paragraph', SIZE, OVERLAP, 'cp')},{hashed_vectors_ctes('cp', ['doc_id', 'chunk_index'], 'chunk_text', 'hv')}
SELECT 'doc' || cp.doc_id AS filename, cp.chunk_index, cp.chunk_text FROM cp
WHERE cp.doc_id NOT IN (SELECT doc_id FROM hv WHERE n = 0)"""
).replace("FROM documents", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 9 = 6 THEN split_part(text, '.', 1) || '.' ELSE text END AS text) FROM documents)")


@register("upsert_chunks", _UPSERT_SQL)
def upsert_chunks(spark, sf_dir):
    from quire.session import shared_dir

    docs = read_table(spark, sf_dir, "documents")
    root = shared_dir(spark, "upserted")
    S.upsert_chunks(spark, root, I.index_documents(docs), DIMS, buckets=16)
    again = I.index_documents(second_version(docs), provider=FailingProvider(DIMS), waits=())
    S.upsert_chunks(spark, root, again, DIMS)
    return S.read_chunks(spark, root, DIMS).select("filename", "chunk_index", "chunk_text")


# E2, learnt: scores of the co-occurrence matrix, and retrieval with what is learnt from it.
_WORDS_SQL = f"""tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), {O.q(E.TOKEN_SPLIT)})) AS word FROM documents),
vocabulary AS (SELECT word, count(DISTINCT doc_id) AS n_docs FROM tok WHERE word <> '' GROUP BY word
               HAVING count(DISTINCT doc_id) >= {W.MIN_DOCS} ORDER BY n_docs DESC, word LIMIT {W.SIZE}),
listed AS (SELECT doc_id, list_filter(string_split_regex(lower(text), {O.q(E.TOKEN_SPLIT)}), lambda x: x <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM listed),
p AS (SELECT placed.* FROM placed JOIN vocabulary USING (word))"""


@register(
    "cooccurrence_scores",
    f"""WITH {_WORDS_SQL},
far AS (SELECT unnest(range(1, {W.WINDOW + 1})) AS d),
n AS (SELECT least(a.word, b.word) AS word, greatest(a.word, b.word) AS other, count(*) AS n
      FROM p a JOIN far ON TRUE JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + far.d GROUP BY ALL),
s AS (SELECT w, sum(n)::DOUBLE AS s FROM (SELECT word AS w, n FROM n UNION ALL SELECT other, n FROM n) GROUP BY w),
v AS (SELECT n.word, n.other, n.n, ln(n.n * (CASE WHEN n.word = n.other THEN 2 ELSE 1 END) * (SELECT sum(s) FROM s) / (a.s * b.s)) AS x
      FROM n JOIN s a ON a.w = n.word JOIN s b ON b.w = n.other)
SELECT word, other, n, round(x, 4) AS score FROM v WHERE x > 0""",
)
def cooccurrence_scores(spark, sf_dir):
    """Positive pointwise mutual information of all pairs of vocabulary words, over whole texts."""
    docs = read_table(spark, sf_dir, "documents")
    words = [r["word"] for r in W.vocabulary(docs, "text").collect()]
    names = spark.createDataFrame(list(enumerate(words)), "k long, w string")
    out = W.ppmi(W.pair_counts(docs, "text", words)).join(names.select(F.col("k").alias("i"), F.col("w").alias("a")), "i").join(names.select(F.col("k").alias("j"), F.col("w").alias("b")), "j")
    return out.select(F.least("a", "b").alias("word"), F.greatest("a", "b").alias("other"), "n", F.round("value", 4).alias("score"))


@register("learnt_retrieval")
def learnt_retrieval(spark, sf_dir):
    """The five documents nearest to each benchmark text by the learnt embedding (no SQL: it is learnt)."""
    from quire.session import shared_dir

    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    provider = W.learnt_provider(docs)
    path = shared_dir(spark, "learnt-vectors")
    E.embed_texts(docs.select(F.col("doc_id").alias("id"), "text"), "text", provider).select("id", "embedding").write.parquet(path)
    stored = spark.read.schema("id long, embedding array<float>").parquet(path)  # counted, then searched: embedded once
    asked = E.embed_texts(bench.select(F.col("item_id").alias("query_id"), "text"), "text", provider, E.QUERY_TASK).select("query_id", F.col("embedding").alias("query"))
    return round_doubles(R.search_batch(stored, asked, 5))
