"""Query registry: name -> (builder, DuckDB oracle SQL or None).

``QUERIES[name] = (builder(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Every builder reads the driver tables (or projections Spark derives from
them), so its work grows with the data. Floating results are rounded to 6
places on both sides so value hashes compare equal across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

ROUND = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def round_doubles(df: DataFrame, places: int = ROUND) -> DataFrame:
    """Round every double/float column (top level) for cross-engine comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
