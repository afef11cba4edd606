"""Shared parts of the training-data operators: tables staged in the shared
folder, columns whose names cannot clash, distributed connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_dir


def staged(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: lineage is cut, lost executors only re-read files. ``few``: little comes
    from many tasks (a narrow scan's survivors, say), so it is rebalanced into files
    of fair size instead of a tiny one for each task."""
    path = shared_dir(df.sparkSession, name)
    (df.hint("rebalance") if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Whole documents travel to Python in Arrow batches, which both sides hold: keep a
    batch to 8 MB of this session's (64 MB by default) however many rows that is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def own(name: str) -> str:
    """A working column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def col(name: str) -> Column:
    """A column by its literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name (dots, blanks): positions go through Spark,
    ``run`` sees and gives the names."""
    lean(df.sparkSession)
    names, given = df.columns, schema.names
    safe = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        for out in run(named):
            yield pa.RecordBatch.from_arrays(out.columns, names=safe.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(by_name, safe).toDF(*given)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star
    and small-star steps: every node is joined to the smallest node it knows.
    Returns (node, component), component = smallest node reachable; isolated
    nodes are not listed. Hubs only ever aggregate a minimum (map-side combined);
    no group is collected. Null or self edges are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = staged(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v")
        e = staged(small.distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
