"""Readers for the driver tables (one Parquet file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows carry whole texts: per-row CPU work (regex, chunking, embedding)
# dominates, so a session may ask for a spread by these keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
SPREAD = "quire.text.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Read one driver table; Parquet carries the schema, nothing is inferred.

    One rule at every size: if the session sets ``quire.text.partitions``, text tables
    are hash-spread into that many partitions (for files of few, large row groups);
    else rows stay in the scan's splits."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = int(spark.conf.get(SPREAD, None) or 0)
    return df.repartition(parts, TEXT_TABLES[name]) if spread and parts and name in TEXT_TABLES else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose driver tables as temporary views (the only thing guarded SQL sees)."""
    for name in names:
        read_table(spark, sf_dir, name, spread=False).createOrReplaceTempView(name)
