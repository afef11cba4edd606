"""Incremental indexing (S13): new files by Structured Streaming, changed ones by ledger.

New document files in a folder are picked up by the file source; each micro-batch is
indexed and upserted (replace by key, so a batch delivered again leaves the same
table). The file source knows a file by its path alone, so the path, modification time
and length of every indexed file go into a ledger beside the table;
``reindex_changed`` lists the folder, and indexes files that the ledger has otherwise.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.embedding import Provider
from quire.plans import indexing as I
from quire.session import shared_dir
from quire.sources import store as S

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LEDGER = "path string, modified timestamp, length bigint, noted timestamp"
FILE = ["path", "modified", "length"]
FILES_A_GROUP = 1000


def _with_file(df: DataFrame) -> DataFrame:
    m = F.col("_metadata")
    return df.select("*", m.file_path.alias("path"), m.file_modification_time.alias("modified"), m.file_size.alias("length"))


def _index(batch: DataFrame, root: str, strategy: str, dims: int, provider: Provider | None) -> None:
    spark = batch.sparkSession
    S.upsert_chunks(spark, root, I.index_documents(batch.drop(*FILE), strategy, provider=provider), dims)
    files = batch.select(*FILE).distinct().withColumn("noted", F.current_timestamp())
    files.write.mode("append").parquet(f"{root}/ledger")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of every indexed file."""
    rows = S.stored(spark, f"{root}/ledger", LEDGER)
    return rows.groupBy("path").agg(F.max_by(F.struct("modified", "length"), "noted").alias("x")).select("path", "x.*")


def incremental_index(
    spark: SparkSession,
    source: str,
    target_root: str,
    checkpoint: str,
    strategy: str = I.FLAGSHIP_STRATEGY,
    dims: int = I.DIMS,
    max_files_per_trigger: int | None = None,
    provider: Provider | None = None,
) -> StreamingQuery:
    """Index what is there and not yet seen, then stop (``availableNow``)."""
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = _with_file(reader.parquet(source))
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: _index(batch, target_root, strategy, dims, provider))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def reindex_changed(
    spark: SparkSession,
    source: str,
    target_root: str,
    strategy: str = I.FLAGSHIP_STRATEGY,
    dims: int = I.DIMS,
    provider: Provider | None = None,
) -> int:
    """Index the files whose modification time or length differ from the ledger's (or
    that it lacks) and return how many there were. Only names reach the driver, FILES_A_GROUP
    at a time."""
    files = spark.read.format("binaryFile").load(source).select("path", F.col("modificationTime").alias("modified"), "length")
    # the listing and the reader write a local path with one slash or three
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    known = read_ledger(spark, target_root).select(plain("path").alias("path"), "modified", "length")
    changed = files.withColumn("path", plain("path")).join(known, FILE, "left_anti")
    # the list is fixed before the ledger grows, and read a bounded number of names at a time
    path = shared_dir(spark, "changed-files")
    changed.select("path").write.parquet(path)
    n, group = 0, []
    for r in itertools.chain(spark.read.parquet(path).toLocalIterator(), [None]):
        if r is not None:
            group.append(r["path"])
        if group and (r is None or len(group) == FILES_A_GROUP):
            _index(_with_file(spark.read.schema(DOCUMENT_SCHEMA).parquet(*group)), target_root, strategy, dims, provider)
            n, group = n + len(group), []
    return n
