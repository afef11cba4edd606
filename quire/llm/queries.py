"""One query for each training-data operator, over its whole table; name ->
(builder, DuckDB SQL or None). Where there is no SQL, tests/llm compares the query
with a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, html, language, lines, mixing, neardup, negatives, pii, prefixes, records, shards, toxicity, vectors

#: The registered query's key; a real run passes its own.
SURROGATE_KEY = "example key"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public byte-level tokenizer lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "n_entities", "kinds", "text")


@query("op3_mix_sources", mixing.MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_token_records")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records_report(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_links(table(spark, sf_dir, "embeddings"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


@query("op7_site_line_dedup", lines.LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.page_lines(table(spark, sf_dir, "pages"))


@query("op8_shard_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_benchmark_decontamination", decontam.REPORT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_hard_negatives", negatives.NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_report(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_trie", prefixes.TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))
