"""Vector math on ``ARRAY<FLOAT>`` columns (Q1, E3, E4) as native expressions.

Products and sums run in double even though vectors are stored as float32.
These expressions are the JVM path for per-row similarity; the blocked numpy
path for many queries lives in ``quire.operators.retrieval``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


# Q1
def cosine_similarity(a, b) -> Column:
    """``1 - cosine distance``; range [-1, 1]; null when a norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


# E3
def truncate_dims(v, dims: int) -> Column:
    if dims <= 0:
        raise ValueError("dims must be greater than 0.")
    return F.slice(_c(v), 1, dims)


# E4
def l2_normalize(v) -> Column:
    """Unit-length vector in float32; null for a zero vector (caller flags it)."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: (x.cast("double") / n).cast("float")))


def vector_text(v, scale: int = 6) -> Column:
    """Deterministic text form of a vector, each component rounded to ``scale``.

    Used to compare vectors across engines without float formatting noise.
    """
    return F.array_join(
        F.transform(_c(v), lambda x: x.cast("double").cast(f"decimal(18,{scale})").cast("string")), ","
    )
