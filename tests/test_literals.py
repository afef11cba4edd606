"""Literal scan against Python's ``in``; values stay out of plans."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import literals as L

TEXT = "name John Smith, pass p@ss!word#9; naïve é\U0001f600 tail\nab" + "x" * 30


def plain(rows, values):
    return sorted({(i, hashlib.sha256(v.encode()).hexdigest()) for i, t in rows for v in values if v and t and v in t}, key=str)


def got(spark, rows, values, **options):
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, row_id string")
    lit = spark.createDataFrame([(v, 1) for v in values], "value string, text int")
    return sorted((tuple(r) for r in L.scan_literals(df, "doc_id", "text", lit, **options).collect()), key=str)


def test_values_with_blanks_and_punctuation(spark):
    rows = [(1, TEXT), (2, "John  Smith"), (3, None), (4, ""), (1, TEXT), (None, "p@ss!word#9"), (5, "é" * 400_000 + "John Smith")]
    values = ["John Smith", "p@ss!word#9", "ohn Smi", "é\U0001f600", "x", "xx", "xxx", "x" * 30, "x" * 31, "tail\nab", "", None, "John Smith", "é"]
    assert got(spark, rows, values) == plain(rows, values)
    assert got(spark, rows, []) == [] and got(spark, [], values) == []


@pytest.mark.parametrize("most", [3, 1000])
def test_passes_give_the_same_rows(spark, most):
    rows = [(i, f"user {i} secret-{i % 7}-{i * i} end") for i in range(60)]
    values = [f"secret-{a}-{b * b}" for a in range(7) for b in range(12)] + ["user 1", "nd", "e"]
    assert got(spark, rows, values, most=most) == plain(rows, values)


def test_values_are_absent_from_the_plan(spark):
    df = spark.createDataFrame([(1, "John Smith")], "doc_id long, text string")
    lit = spark.sql("SELECT 'unused' AS other, 'John Smith' AS value")
    plan = L.scan_literals(df, "doc_id", "text", lit)._jdf.queryExecution().toString()
    assert "John" not in plan.replace("LocalTableScan", "") and "Smith" not in plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé ", max_size=40), min_size=1, max_size=4), st.lists(st.text("abé ", min_size=1, max_size=12), min_size=1, max_size=8))
def test_kernel_equals_in(texts, values):
    import numpy as np

    raw = [t.encode() for t in texts]
    rows = []
    for v in values:
        b = L._Bytes(np.frombuffer(v.encode(), np.uint8))
        n = len(v.encode())
        rows.append((n, int(b.anchors(L._gram(n))[0]), int(b.hashes(np.zeros(1, np.int64), n)[0]), hashlib.sha256(v.encode()).digest()))
    off = np.cumsum([0, *map(len, raw)])
    found = set(L.found_in(np.frombuffer(b"".join(raw), np.uint8), off, L.values_of(rows)))
    assert found == {(i, hashlib.sha256(v.encode()).digest()) for i, t in enumerate(texts) for v in values if v in t}
