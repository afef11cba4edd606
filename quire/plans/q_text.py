"""Registered text cleaning and structure queries (T1-T12) on soiled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans import oracle as O
from quire.plans.registry import register
from quire.plans.fixtures import soiled_documents
from quire.sources.tables import read_table

_SOILED = f"SELECT doc_id, {O.soil('text')} AS text FROM documents"

_STEPS = [
    ("null_to_empty", X.null_to_empty, O.t1),
    ("normalize_newlines", X.normalize_newlines, O.t2),
    ("dehyphenate", X.dehyphenate, O.t3),
    ("strip_control_chars", X.strip_control_chars, O.t4),
    ("collapse_spaces", X.collapse_spaces, O.t5),
    ("trim_around_newlines", X.trim_around_newlines, O.t6),
    ("collapse_blank_lines", X.collapse_blank_lines, O.t7),
    ("strip_text", X.strip_text, O.strip),
    ("clean_text", X.clean_text, O.clean),
]


_WITH_NULLS = "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN text END AS text FROM documents"


def _nulls_query(spark, sf_dir):
    """Every fourth text null."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.null_to_empty(F.when(F.col("doc_id") % 4 != 0, F.col("text"))).alias("text"))


def _step_query(fn):
    def build(spark, sf_dir):
        return soiled_documents(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("text"))

    return build


for _name, _fn, _sql in _STEPS:
    if _name == "null_to_empty":
        register(_name, f"WITH s AS ({_WITH_NULLS}) SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE text END AS text FROM s")(_nulls_query)
        continue
    register(_name, f"WITH s AS ({_SOILED}) SELECT doc_id, {_sql('text')} AS text FROM s")(_step_query(_fn))


def cleaned_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("text"))


_CLEAN_SQL = f"SELECT doc_id, {O.clean('text')} AS t FROM documents"


@register(
    "column_width",
    f"""WITH c AS ({_CLEAN_SQL}),
l AS (SELECT doc_id, length({O.strip('line')}) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c))
SELECT c.doc_id, m.width AS column_width, m.width * {X.WIDTH_FACTOR} AS ragged_threshold
FROM c LEFT JOIN (SELECT doc_id, CAST(median(n) FILTER (WHERE n > {X.BODY_MIN_LEN}) AS DOUBLE) AS width FROM l GROUP BY doc_id) m
USING (doc_id)""",
)
def column_width(spark, sf_dir):
    lines = X.split_lines(F.col("text"))
    return cleaned_documents(spark, sf_dir).select(
        "doc_id", X.column_width(lines).alias("column_width"), X.ragged_threshold(lines).alias("ragged_threshold")
    )


@register(
    "is_heading",
    f"""WITH c AS ({_CLEAN_SQL}),
l AS (SELECT doc_id, {O.strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c))
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines,
       count(*) FILTER (WHERE line <> '' AND {O.is_heading('line')}) AS n_headings
FROM l GROUP BY doc_id""",
)
def is_heading(spark, sf_dir):
    lines = F.filter(X.split_lines(F.col("text")), lambda l: l != "")
    return cleaned_documents(spark, sf_dir).select(
        "doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, X.is_heading)).alias("n_headings")
    )


REFLOW_SQL = f"""WITH c AS ({_CLEAN_SQL}),{O.reflow_ctes('c')}
SELECT doc_id, t AS text FROM reflowed"""


@register("reflow_paragraphs", REFLOW_SQL)
def reflow_paragraphs(spark, sf_dir):
    return X.reflow_paragraphs(cleaned_documents(spark, sf_dir), "text")
