"""Interval join against all pairs."""

import random

from pyspark.sql import functions as F

from quire.operators import ranges
from quire.operators.ranges import interval_join


def plain(points, intervals):
    return sorted((i, j) for i, v in points for j, lo, hi in intervals if None not in (v, lo, hi) and abs(v) < 1e300 and lo <= v < hi and abs(lo) < 1e300 and abs(hi) < 1e300)


def got(spark, points, intervals):
    p = spark.createDataFrame([(*r, "x") for r in points], "a long, v double, lo string")
    i = spark.createDataFrame([(*r, "y") for r in intervals], "a long, lo double, hi double, p string")
    out = interval_join(p, F.col("v"), i, F.col("lo"), F.col("hi"))
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    return sorted((r["a"], r["b"]) for r in out.select(F.col("p.a").alias("a"), F.col("i.a").alias("b")).collect())


def test_equals_all_pairs(spark):
    r = random.Random(4)
    points = [(k, r.choice([r.uniform(-50, 50), float(r.randint(-5, 5)), r.gauss(0, 1e6)])) for k in range(300)]
    intervals = []
    for k in range(200):
        lo = r.choice([r.uniform(-60, 60), float(r.randint(-5, 5)), r.gauss(0, 1e6)])
        intervals.append((k, lo, lo + r.choice([0.0, -1.0, 0.25, 1.0, 3.0, 5000.0, 1e7])))
    want = plain(points, intervals)
    assert len(want) > 1000
    assert got(spark, points, intervals) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, None), (2, nan), (3, inf), (4, 0.0), (5, 1.0), (5, 1.0), (6, -inf), (7, 1e299)]
    intervals = [(1, 0.0, 1.0), (2, None, 5.0), (3, 0.0, None), (4, nan, 1.0), (5, -inf, inf), (6, 1.0, 1.0), (7, 2.0, 1.0), (8, 1.0, 1.5), (8, 1.0, 1.5)]
    assert got(spark, points, intervals) == [(4, 1), (5, 8), (5, 8), (5, 8), (5, 8)]
    assert got(spark, [], intervals) == [] and got(spark, points, []) == []
    same = [(k, 7.0) for k in range(50)]
    assert len(got(spark, same, [(1, 6.0, 8.0), (2, 7.0, 7.5)])) == 100


def test_totals_equal_those_of_all_pairs(spark, monkeypatch):
    """Many bins, many intervals ending in one bin, repeated rows, nulls: no pair becomes a row."""
    monkeypatch.setattr(ranges, "BLOCK", 16)
    r = random.Random(9)
    rows = [(k, r.choice([r.uniform(-50, 50), float(r.randint(-5, 5)), 1e299, None]), r.choice([None, float(r.randint(-9, 9))])) for k in range(300)]
    rows += rows[:20] + [(None, 3.0, float("nan")), (None, 70.0, None), (None, 70.0, None)]
    spans = [(k % 150, *r.choice([(x := r.uniform(-60, 60), x + r.choice([0.0, -1.0, 0.3, 40.0, 500.0])), (-5.0, x), (3.0, 3.5), (69.0, 71.0), (None, 4.0)])) for k in range(200)]
    spans += spans[:10]
    p = spark.createDataFrame(rows, "a long, v double, x double")
    i = spark.createDataFrame(spans, "b long, lo double, hi double")
    out = interval_join(p, F.col("v"), i, F.col("lo"), F.col("hi"), {"s": ("sum", F.col("x")), "m": ("min", F.col("a")), "l": ("min", F.col("x"))})
    assert out.schema.simpleString() == "struct<i:struct<b:bigint,lo:double,hi:double>,n:bigint,s:double,m:bigint,l:double>"
    got = [(*f["i"], f["n"], f["s"], f["m"], f["l"]) for f in out.collect()]
    want = []
    for b, lo, hi in spans:
        mine = [q for q in rows if None not in (lo, hi, q[1]) and abs(q[1]) < 1e300 and lo <= q[1] < hi]
        xs, ks = [q[2] for q in mine if q[2] is not None], [q[0] for q in mine if q[0] is not None]
        if mine:
            least = min((x for x in xs if x == x), default=None)
            want.append((b, lo, hi, len(mine), sum(xs) if xs else None, min(ks, default=None), least))
    assert len(want) > 100 and sorted(map(repr, got)) == sorted(map(repr, want))
    assert interval_join(p.limit(0), F.col("v"), i, F.col("lo"), F.col("hi"), {}).count() == 0
    assert interval_join(p, F.col("v"), i.limit(0), F.col("lo"), F.col("hi"), {"s": ("sum", F.col("x"))}).count() == 0
    # values far apart: a huge one must not drown its neighbours, as the difference of running sums would
    near = spark.createDataFrame([(1, 0.0, 1e300), (2, 1.0, 0.25), (3, 2.0, 0.5)], "a long, v double, x double")
    one = spark.createDataFrame([(1, 0.5, 3.0)], "b long, lo double, hi double")
    assert interval_join(near, F.col("v"), one, F.col("lo"), F.col("hi"), {"s": ("sum", F.col("x"))}).first()["s"] == 0.75
