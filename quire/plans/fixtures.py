"""Derived inputs built from the driver tables (FIXTURES.md section 2).

Each function is a pure projection of a given table, so its size grows with the
data; the DuckDB oracle applies the very same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

# Ticket derivation from `events`.
CATEGORY_BY_EVENT = {
    "error": "Technical Support",
    "signup": "Account Access",
    "purchase": "Billing",
    "view": "Subscription",
    "click": "Login Issue",
}
STATUS_BY_MOD3 = ("Open", "In Progress", "Closed")
HIGH_VALUE = 60.0
MEDIUM_VALUE = 20.0
STRATEGIES = ("fixed", "sentence", "paragraph")
FIXTURE_TIME = "2026-01-01 00:00:00"


def soil(col) -> F.Column:
    """Deterministic soiling: CR/LF runs, hyphen breaks, tabs, BEL and edge spaces."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.replace(c, F.lit(". "), F.lit(".\r\n\r\n\n"))
    c = F.replace(c, F.lit("tion"), F.lit("ti-\non"))
    c = F.replace(c, F.lit(", "), F.lit(",\t  "))
    return F.concat(F.lit("\x07  "), c, F.lit("  \n"))


def soiled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", soil("text").alias("text"))


def tickets(spark: SparkSession, sf_dir: str, with_value: bool = False) -> DataFrame:
    """support_requests at scale, one ticket per event (``value`` optional)."""
    ev = read_table(spark, sf_dir, "events")
    cat = F.create_map(*[F.lit(x) for kv in CATEGORY_BY_EVENT.items() for x in kv])
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_MOD3]), (F.col("event_id") % 3 + 1).cast("int"))
    priority = (
        F.when(F.col("value") >= HIGH_VALUE, "High").when(F.col("value") >= MEDIUM_VALUE, "Medium").otherwise("Low")
    )
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Customer "), F.col("user_id").cast("string")).alias("customer_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        cat[F.col("event_type")].alias("category"),
        priority.alias("priority"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        *([F.col("value")] if with_value else []),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as support messages with a given intent."""
    conv = read_table(spark, sf_dir, "conversations")
    intents = F.array(*[F.lit(x) for x in INTENTS])
    return conv.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn"),
        F.col("text").alias("message"),
        F.element_at(intents, ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")).alias("intent"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Customer "), (F.col("conv_id") % 150).cast("string"))).alias(
            "subject"
        ),
    )


INTENTS = ("SMALL_TALK", "DATA_LOOKUP", "ACTION_REQUEST", "GENERAL_KNOWLEDGE", "UNCLEAR")


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_chunks rows standing on the stored vectors of `embeddings`."""
    emb = read_table(spark, sf_dir, "embeddings")
    strat = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (F.col("vec_id") % 3 + 1).cast("int"))
    return emb.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" label "), F.col("label").cast("string")).alias(
            "chunk_text"
        ),
        F.col("embedding"),
        F.concat(F.lit("file"), F.col("label").cast("string")).alias("filename"),
        strat.alias("split_strategy"),
        (F.col("vec_id") / 30).cast("int").alias("chunk_index"),
        F.lit(FIXTURE_TIME).cast("timestamp_ntz").alias("created_at"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector is also a query (self-kNN over the whole table)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


QUERY_EVERY = 50  # the stated query set of searches: ids divisible by this, against all rows


def stated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector whose id is divisible by 50 is a query."""
    return query_vectors(spark, sf_dir).where(F.col("query_id") % QUERY_EVERY == 0)
