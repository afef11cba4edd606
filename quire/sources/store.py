"""The chunk table (S6-S9): schema, checks, ids, and idempotent replacement.

A table is a plain Parquet dataset under its root, partitioned by (buckets, split_strategy, bucket),
``bucket`` being the hash of the filename modulo the table's own bucket count, which
the first load fixes and every row's partition names. Any Spark reader can read it.

An upsert embeds nothing twice: new rows are staged once in the shared folder and checked;
the old rows that stay in the partitions they touch, found by partition filter, are read where they are, and both are
put in place by Spark's dynamic partition overwrite, which replaces just these partitions and removes their old files
once all rows are written. Beside the table and partitioned alike, ``quarantine`` holds the documents whose newest version
was refused; one that is accepted later leaves it.

Writers that touch different partitions do not disturb one another. Of two writers of one partition the later
to finish wins for the whole partition, so such upserts belong one after another. An upsert that
was broken off is repeated: writing the same rows twice leaves the same table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("fixed", "sentence", "paragraph")
KEY = ["filename", "split_strategy"]


# S6
def chunk_schema(dims: int) -> T.StructType:
    """document_chunks; every column is NOT NULL, the vector is ``dims`` wide."""
    return T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("chunk_text", T.StringType(), False),
            T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
            T.StructField("filename", T.StringType(), False),
            T.StructField("split_strategy", T.StringType(), False),
            T.StructField("chunk_index", T.IntegerType(), False),
            T.StructField("created_at", T.TimestampType(), False),
        ]
    )


def check_chunks(df: DataFrame, dims: int) -> DataFrame:
    """Adds ``violation`` (null when the row satisfies the table constraints)."""
    v = (
        F.when(F.col("chunk_text").isNull(), "chunk_text is null")
        .when(F.col("embedding").isNull(), "embedding is null")
        .when(F.col("filename").isNull(), "filename is null")
        .when(F.col("split_strategy").isNull(), "split_strategy is null")
        .when(F.col("chunk_index").isNull(), "chunk_index is null")
        .when(F.size("embedding") != dims, F.concat(F.lit("embedding width "), F.size("embedding").cast("string"),
                                                   F.lit(f" <> {dims}")))
        .when(~F.col("split_strategy").isin(*STRATEGIES), "unknown split_strategy")
        .when(F.col("chunk_index") < 0, "negative chunk_index")
    )
    return df.withColumn("violation", v)


# S8
STRATEGY_CODE = {"fixed": 0, "sentence": 1, "paragraph": 2}
INDEX_BITS = 22  # 4,194,304 chunks per document and strategy
DOC_BITS = 39  # documents: what is left of 63 bits, 2 going to the strategy


def assign_ids(df: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Deterministic ids from (document, strategy, chunk_index), so re-indexing keeps
    them; a chunk or document number that does not fit its bits stops the job rather
    than take another chunk's id. ``created_at`` defaults to the statement time."""
    doc, idx = F.col(doc_key).cast("long"), F.col("chunk_index").cast("long")
    code = F.create_map(*[F.lit(x) for kv in STRATEGY_CODE.items() for x in kv])[F.col("split_strategy")].cast("long")
    ident = doc * F.lit(1 << (INDEX_BITS + 2)) + code * F.lit(1 << INDEX_BITS) + idx
    too_big = (doc < 0) | (doc >= F.lit(1 << DOC_BITS)) | (idx < 0) | (idx >= F.lit(1 << INDEX_BITS))
    refuse = F.raise_error(F.concat(F.lit("no id for document "), doc.cast("string"), F.lit(", chunk "), idx.cast("string"))).cast("long")
    out = df.withColumn("id", F.when(too_big, refuse).otherwise(ident))
    if "created_at" not in df.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    return out


# S9
def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"))


# S7 (logical form)
def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of ``new``; rows of ``existing`` survive only for keys absent
    from ``new`` (so stale higher indexes of a shrinking document vanish).
    The key set is small relative to the table and is hash-joined (AQE turns
    it into a broadcast when its measured size allows)."""
    keys = new.select(*KEY).distinct()
    kept = existing.join(keys, KEY, "left_anti")
    return kept.unionByName(new.select(*existing.columns))


# S7 (physical form)
NO_NAME = "?"
ROWS_A_BUCKET, MIN_BUCKETS = 4096, 16  # of a table created without a count of its own: by its first load


def stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet dataset at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _table(spark: SparkSession, root: str, dims: int) -> DataFrame:
    parts = [T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
    return stored(spark, f"{root}/data", T.StructType([*chunk_schema(dims).fields, *parts]))


def read_chunks(spark: SparkSession, root: str, dims: int) -> DataFrame:
    return _table(spark, root, dims).select(*chunk_schema(dims).names)


REFUSED = "filename string, reason string, buckets int, split_strategy string, bucket int"


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """(filename, split_strategy, reason) of the documents whose newest version was refused."""
    rows = stored(spark, f"{root}/quarantine", REFUSED).where("reason is not null")
    return rows.select(*(F.col(c) if c == "reason" else F.nullif(F.col(c), F.lit(NO_NAME)).alias(c) for c in (*KEY, "reason")))


def _aside(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` staged: its size is known, and it is made once."""
    from quire.session import shared_dir

    staged = shared_dir(spark, "kept")
    df.write.parquet(staged)
    return spark.read.schema(df.schema).parquet(staged)


def _place(df: DataFrame, path: str) -> None:
    """Replace the partitions that ``df`` has rows of."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("buckets", "split_strategy", "bucket").parquet(path)


def _near(touched: dict[str, list[int]]):
    """A filter on partition columns alone, so only these folders are listed and read."""
    out = F.lit(False)
    for strategy, mine in sorted(touched.items()):
        out = out | ((F.col("split_strategy") == strategy) & F.col("bucket").isin(sorted(mine)))
    return out


def _touched(df: DataFrame) -> dict[str, list[int]]:
    """The partitions of some rows: three a bucket at most."""
    out: dict[str, list[int]] = {}
    for r in df.select("split_strategy", "bucket").distinct().collect():
        out.setdefault(r["split_strategy"], []).append(r["bucket"])
    return out


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("filename"), F.lit(buckets)).cast("int")


def upsert_chunks(spark: SparkSession, root: str, new: DataFrame, dims: int, buckets: int | None = None) -> int:
    """Replace by (filename, split_strategy) and return how many partitions were rewritten.

    ``new`` may carry ``embed_error``. A document with a failed or unfit chunk
    (``check_chunks``) goes to quarantine whole: none of its rows is written and
    its old rows stay. The bucket count is the table's own; another one is refused.
    Writing the same rows twice leaves the same table."""
    from quire.session import shared_dir

    cols = chunk_schema(dims).names
    error = F.col("embed_error") if "embed_error" in new.columns else F.lit(None).cast("string")
    staged = shared_dir(spark, "new-chunks")
    checked = check_chunks(new.withColumn("embed_error", error), dims)
    checked.select(*cols, F.coalesce("embed_error", "violation").alias("reason")).write.parquet(staged)
    fresh = spark.read.parquet(staged)

    table = _table(spark, root, dims)
    known = table.select("buckets").first()
    if known is not None and buckets not in (None, known[0]):
        raise ValueError(f"the table has {known[0]} buckets, not {buckets}")
    buckets = known[0] if known is not None else buckets or max(MIN_BUCKETS, -(-fresh.count() // ROWS_A_BUCKET))

    # names are staged before they are joined: Spark then knows that they are few, and does not shuffle the vectors for them
    refused = _aside(spark, fresh.where("reason is not null").groupBy(*KEY).agg(F.min("reason").alias("reason")))
    good = fresh
    if not refused.isEmpty():
        key = [F.col(f"n.{c}").eqNullSafe(F.col(f"q.{c}")) for c in KEY]
        good = fresh.alias("n").join(refused.alias("q"), key[0] & key[1], "left_anti").select("n.*")
    good = good.withColumn("bucket", bucket_of(buckets))
    touched = _touched(good)
    if touched:
        merged = good.select(*cols)
        if known is not None:
            # the old rows that stay come straight from the table: Spark's dynamic overwrite removes files only after all tasks are done
            names = _aside(spark, good.select(*KEY).distinct())
            merged = merged.unionByName(table.where(_near(touched)).select(*cols).join(names, KEY, "left_anti").select(*cols))
        merged = merged.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket_of(buckets))
        # AQE splits a large partition into several files and tasks: none is one task's alone
        _place(merged.hint("rebalance", "split_strategy", "bucket").sortWithinPartitions("split_strategy", "bucket", "filename", "chunk_index"), f"{root}/data")

    # documents without a name or strategy are filed under a stand-in
    named = lambda df: df.select(*(F.coalesce(c, F.lit(NO_NAME)).alias(c) for c in KEY), "reason", F.lit(buckets).alias("buckets")).withColumn("bucket", bucket_of(buckets))
    seen, now = named(fresh.groupBy(*KEY).agg(F.min("reason").alias("reason"))), named(refused)
    held = stored(spark, f"{root}/quarantine", REFUSED)
    if not now.isEmpty() or not held.isEmpty():
        old = held.where(_near(_touched(seen)) & F.col("reason").isNotNull()).join(seen.select(*KEY), KEY, "left_anti")
        # a row without a reason for each partition, so that one whose documents all left is replaced too
        empty = seen.select(F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("reason"), "buckets", "split_strategy", "bucket").distinct()
        _place(_aside(spark, now.unionByName(old).unionByName(empty)), f"{root}/quarantine")
    return sum(map(len, touched.values()))
