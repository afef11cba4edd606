"""A8d: joins on "value lies in an interval", as equi-joins on bins.

An interval [low, high) is filed under the bins it overlaps, a value under its own bin, and
the join is on the bin, with the condition checked once more: no nested loop, and every
pair is found exactly once, because a value has one bin a level.

Bins are hierarchical. On level 0 they are as wide as a common interval (the median length); each
level is FAN times as wide. An interval is filed on the lowest level where it overlaps at
most FAN + 1 bins, so long intervals do not multiply; a value is filed once for each
level that has intervals, LEVELS at most.

Where only totals of an interval's points are asked for, no pair becomes a row: points of one value are summed
first and dealt into bins of alike many values; an interval takes what lies in its two outer bins from these, in
tasks of a bounded number of values, and the bins between from their totals. That grows with points plus
intervals, not with the pairs.

Defined results: nulls and nan match nothing, nor do intervals with low >= high; values and bounds
must be finite to match. Repeated rows match each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_dir

FAN = 16
LEVELS = 16  # beyond the last level an interval takes as many bins as it needs
BLOCK = 1 << 16  # values of a bin, and ends of intervals that one task answers from it


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e300))


def interval_join(points: DataFrame, value: Column, intervals: DataFrame, low: Column, high: Column, totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Rows (struct ``p`` of a point, struct ``i`` of an interval) with low <= value < high.

    With ``totals``, names to ("sum" or "min", numeric column of the points): one row an interval that holds points,
    of ``i``, their number ``n`` and those totals, nulls left out as Spark's own aggregates do."""
    if totals is not None:
        return _interval_totals(points, value, intervals, low, high, totals)
    p = points.select(F.struct("*").alias("p"), value.cast("double").alias("__v")).where(_finite(F.col("__v")))
    i = intervals.select(F.struct("*").alias("i"), low.cast("double").alias("__lo"), high.cast("double").alias("__hi"))
    i = i.where(_finite(F.col("__lo")) & _finite(F.col("__hi")) & (F.col("__lo") < F.col("__hi")))
    length = F.col("__hi") - F.col("__lo")
    median, longest = i.agg(F.percentile_approx(length, 0.5, 1000), F.max(length)).first()
    # no interval at all: any width will do. Of extreme data, bin numbers still fit 63 bits
    reach = max(abs(x or 0.0) for x in (p.agg(F.max(F.abs("__v"))).first()[0], i.agg(F.max(F.greatest(F.abs("__lo"), F.abs("__hi")))).first()[0]))
    width = max(median or 1.0, reach / 2.0**52, 1e-290)
    levels = min(LEVELS, 1 + max(0, math.ceil(math.log(max((longest or width) / width, 1.0) / FAN, FAN)))) if longest else 1
    level = F.lit(0)
    for k in range(1, levels):
        level = F.when(length > F.lit(width * FAN**k), F.lit(k)).otherwise(level)
    bin_of = lambda x, lv: F.floor(x / (F.lit(width) * F.pow(F.lit(float(FAN)), lv))).cast("long")
    i = i.withColumn("__level", level)
    i = i.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__lo"), F.col("__level")), bin_of(F.col("__hi"), F.col("__level")))))
    p = p.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    p = p.withColumn("__bin", bin_of(F.col("__v"), F.col("__level")))
    found = p.join(i, ["__level", "__bin"]).where((F.col("__lo") <= F.col("__v")) & (F.col("__v") < F.col("__hi")))
    return found.select("p", "i")


def over_ranges(x: np.ndarray, first: np.ndarray, end: np.ndarray, combine: Callable, empty) -> np.ndarray:
    """``combine`` of x[first:end] for each range, from a binary tree over ``x``: nothing is subtracted, so
    a value spoils no range that lacks it."""
    out = np.full(len(first), empty, x.dtype)
    lo, hi = first.copy(), np.maximum(first, end)
    while len(x) and (lo < hi).any():
        odd = (lo < hi) & (lo % 2 == 1)
        out[odd] = combine(out[odd], x[lo[odd]])
        lo[odd] += 1
        odd = (lo < hi) & (hi % 2 == 1)
        hi[odd] -= 1
        out[odd] = combine(out[odd], x[hi[odd]])
        lo, hi = lo // 2, hi // 2
        x = np.append(x, np.full(len(x) % 2, empty, x.dtype))
        x = combine(x[::2], x[1::2])
    return out


def _rule(kind: str, x: np.ndarray) -> tuple[Callable, object]:
    if kind == "sum":
        return np.add, 0
    return (np.minimum, np.iinfo(x.dtype).max) if x.dtype.kind == "i" else (np.fmin, np.nan)


def _columns(kinds: dict[str, str]) -> list[tuple[str, str]]:
    """Columns of partial totals: n, then of each total how many values it has, and itself."""
    return [("n", "sum"), *((c, k) for name, kind in kinds.items() for c, k in ((f"__n_{name}", "sum"), (name, kind)))]


def _range_rows(parts: pa.Table, values: pa.Table, first: np.ndarray, end: np.ndarray, kinds: dict[str, str]) -> pa.Table:
    """__lo, __hi of ``parts`` and the totals of rows first to end of ``values``."""
    made = {"__lo": parts["__lo"], "__hi": parts["__hi"]}
    for c, kind in _columns(kinds):
        x = values[c].to_numpy()
        counts = made.get(f"__n_{c}")
        mask = None if counts is None else counts == 0
        if counts is not None:  # rows whose values are all null hold a stand-in
            x = np.where(values[f"__n_{c}"].to_numpy() == 0, _rule(kind, x)[1], x)
        made[c] = over_ranges(x, first, end, *_rule(kind, x))
        if mask is not None:
            made[c] = pa.array(made[c], mask=mask)
    return pa.table({c: made[c] for c in ("__lo", "__hi", *(c for c, _ in _columns(kinds)))})


def _interval_totals(points: DataFrame, value: Column, intervals: DataFrame, low: Column, high: Column, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    spark, kinds = points.sparkSession, {name: kind for name, (kind, _) in totals.items()}
    if not set(kinds.values()) <= {"sum", "min"}:
        raise ValueError("totals must be sums or minima")
    given = points.select(*[c.alias(name) for name, (_, c) in totals.items()])
    whole = {f.name: kinds[f.name] == "min" and isinstance(f.dataType, T.IntegralType) for f in given.schema.fields}
    wide = {name: "long" if whole[name] else "double" for name in totals}
    types = {c: wide.get(c, "long") for c, _ in _columns(kinds)}
    again = {"sum": F.sum, "min": F.min}
    # a stand-in for values that are all null, so that numbers stay numbers; their count tells
    merged = lambda c, kind: F.coalesce(again[kind](c), F.lit(0).cast(types[c]))

    p = points.select(value.cast("double").alias("__v"), *[c.cast(wide[name]).alias(name) for name, (_, c) in totals.items()]).where(_finite(F.col("__v")))
    p = p.groupBy("__v").agg(F.count(F.lit(1)).alias("n"), *[x for name, kind in kinds.items() for x in (F.count(name).alias(f"__n_{name}"), merged(name, kind).alias(name))])
    path = shared_dir(spark, "points-by-value")
    p.write.parquet(path)  # read several times below
    p = spark.read.schema(p.schema).parquet(path)
    bins = max(1, -(-p.count() // BLOCK))
    edges = sorted(set(p.agg(F.percentile_approx("__v", [k / bins for k in range(1, bins)], max(10_000, 10 * bins))).first()[0])) if bins > 1 else []

    def binned(df: DataFrame, c: str, out: str) -> DataFrame:
        if not edges:
            return df.withColumn(out, F.lit(0))
        cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=c, outputCol=out)
        return cut.transform(df).withColumn(out, F.col(out).cast("int"))

    p = binned(p, "__v", "__bin")
    i = intervals.select(F.struct("*").alias("i"), low.cast("double").alias("__lo"), high.cast("double").alias("__hi"))
    i = i.where(_finite(F.col("__lo")) & _finite(F.col("__hi")) & (F.col("__lo") < F.col("__hi")))
    spans = binned(binned(i.select("__lo", "__hi").distinct(), "__lo", "__first"), "__hi", "__last")

    # the two outer bins, or the only one: (from, to) within it
    part = lambda b, lo, hi: F.struct(F.col(b).alias("__bin"), lo.alias("__from"), hi.alias("__to"))
    lo, hi, far = F.col("__lo"), F.col("__hi"), F.lit(math.inf)
    outer = F.when(F.col("__first") == F.col("__last"), F.array(part("__first", lo, hi))).otherwise(F.array(part("__first", lo, far), part("__last", -far, hi)))
    parts = spans.select("__lo", "__hi", F.explode(outer).alias("x")).select("__lo", "__hi", "x.*")
    # a bin that very many intervals end in is answered by several tasks
    tasks = parts.groupBy("__bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__tasks"))  # a row a bin
    parts = parts.join(F.broadcast(tasks.select(F.col("__bin").alias("__b"), "__tasks")), F.col("__bin") == F.col("__b")).withColumn("__task", F.pmod(F.xxhash64("__lo", "__hi"), F.col("__tasks")).cast("int"))
    copies = F.broadcast(tasks.select(F.col("__bin").alias("__of"), F.sequence(F.lit(0), F.col("__tasks") - 1).alias("__copies")))
    values = p.join(copies, F.col("__bin") == F.col("__of")).withColumn("__copy", F.explode("__copies"))
    schema = "__lo double, __hi double, " + ", ".join(f"`{c}` {t}" for c, t in types.items())

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("__v")
        v = right["__v"].to_numpy()
        return _range_rows(left, right, np.searchsorted(v, left["__from"].to_numpy()), np.searchsorted(v, left["__to"].to_numpy()), kinds)

    found = parts.groupBy("__bin", "__task").cogroup(values.groupBy("__of", "__copy")).applyInArrow(answered, schema)
    if len(edges) > 1:
        # the whole bins between: a row of totals a bin, one for BLOCK values
        sums = p.groupBy("__bin").agg(*[merged(c, kind).alias(c) for c, kind in _columns(kinds)]).toArrow().sort_by("__bin")
        numbers = sums["__bin"].to_numpy()

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                first, last = np.searchsorted(numbers, b["__first"].to_numpy() + 1), np.searchsorted(numbers, b["__last"].to_numpy())
                yield from _range_rows(pa.Table.from_batches([b]), sums, first, last, kinds).to_batches()

        found = found.unionByName(spans.where("__last - __first > 1").mapInArrow(between, schema))
    made = found.groupBy("__lo", "__hi").agg(F.sum("n").alias("n"), *[again[kind](name).alias(name) for name, kind in kinds.items()]).where("n > 0")
    kept = {f.name: f.dataType if whole[f.name] else T.DoubleType() for f in given.schema.fields}
    return i.join(made, ["__lo", "__hi"]).select("i", "n", *[F.col(name).cast(t).alias(name) for name, t in kept.items()])
