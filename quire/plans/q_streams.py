"""Registered queries of the stateful streams (S13 with R3, R6): each equals its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import routing as G
from quire.plans import q_routing as R
from quire.plans.fixtures import messages
from quire.plans.registry import QUERIES, register
from quire.session import shared_dir
from quire.streaming import sessions as Z

EPOCH = 1767225600  # 2026-01-01: the conversations carry no times, a turn stands for a second


def _at(order: str):
    return F.timestamp_seconds(F.lit(EPOCH) + F.col(order))


def _streamed(spark, rows, order, keys, made):
    """All rows through a stream in three runs that go on from one checkpoint: half of them by hash, the others, the
    closing row. The halves overlap in time throughout, so the delay is the span of the order column."""
    span = rows.agg(F.max(order) - F.min(order)).first()[0] or 0
    source, target, checkpoint = (shared_dir(spark, f"stream-{x}") for x in ("source", "table", "checkpoint"))
    own = Z.state_session(spark)
    half = F.pmod(F.xxhash64(*keys, order), F.lit(2))
    for part in (rows.where(half == 0), rows.where(half == 1), Z.closing(rows)):
        part.write.mode("append").parquet(source)
        stream = own.readStream.schema(rows.schema).parquet(source)
        Z.write_stream(made(stream, f"{span + 2} seconds"), target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@register("stream_carry_subject", QUERIES["carry_subject"][1])
def stream_carry_subject(spark, sf_dir):
    rows = messages(spark, sf_dir).select("session_id", "turn", "subject", _at("turn").alias("at"))
    written = _streamed(spark, rows, "turn", ["session_id"], lambda s, delay: Z.session_subjects(s, delay=delay))
    return Z.with_session_subject(written).select("session_id", "turn", "subject", "session_subject")


@register("stream_first_attempts", QUERIES["one_email_per_request"][1])
def stream_first_attempts(spark, sf_dir):
    tried = R._attempts(spark, sf_dir).withColumn("v", G.validate_email())
    rows = tried.select("request_id", "attempt", "v.success", "v.recipient", _at("attempt").alias("at"))
    written = _streamed(spark, rows, "attempt", ["request_id"], lambda s, delay: Z.first_attempts(s, delay=delay))
    return written.select("request_id", "attempt", "success", "recipient")
