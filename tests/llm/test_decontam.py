"""Decontamination against a plain scan."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from .test_words import plain

from quire.llm import decontam as D
from quire.llm.words import Words


def brute(text, bench):
    w = plain(text)
    hit, items = set(), set()
    for item, t in bench:
        b = plain(t)
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins] if n else []
        for i in at:
            hit |= set(range(i, i + n))
        if at and item is not None:
            items.add(str(item))
    names = ",".join(sorted(items))
    return len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def case(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("alpha Beta gamma ÉTÉ delta eps zeta 7".split())
    bench = [(i, " ".join(word() for _ in range(r.randint(0, 20)))) for i in range(12)]
    bench += [(50, None), (51, "..."), (None, "no name here at all"), (52, "Short, item!"), (52, "Short, item!")]
    docs = []
    for i in range(80):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 3 == 0:
            t += ". " + (r.choice(bench)[1] or "").upper()
        docs.append((i, t))
    docs += [(90, None), (91, ""), (92, "short ITEM"), (93, "short\nitem " + "filler " * 100), (93, "short item"), (94, "no-name here at all")]
    return docs, bench


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(case()[1], "item_id long, text string")


def test_report_equals_plain_scan(documents, bench):
    rows, items = case()
    got = sorted(tuple(r) for r in D.report(documents(rows), bench).collect())
    want = sorted((i, *brute(t, items)) for i, t in rows)
    assert got == want and any(r[-1] for r in got) and not all(r[-1] for r in got)
    sliced = sorted(tuple(r) for r in D.report(documents(rows), bench, max_broadcast_bytes=40).collect())
    assert sliced == want


def test_documents_or_spans_go(documents, bench):
    rows, items = case()
    docs = documents(rows)
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in rows if not brute(t, items)[-1])
    cut = {r["doc_id"]: r["text"] for r in D.decontaminated(docs.where("doc_id <> 93"), bench, remove="spans").collect()}
    assert len(cut) == 84 and cut[92] == "" and cut[90] is None
    for i, t in rows:
        if i != 93:
            assert len(plain(cut[i])) == len(plain(t)) - brute(t, items)[1]


def test_empty_tables(documents, bench):
    rows, _ = case()
    docs = documents(rows)
    assert D.report(docs.limit(0), bench).count() == 0
    nothing = D.report(docs, bench.limit(0))
    assert nothing.where("n_hit > 0 or contaminated").count() == 0 and nothing.count() == len(rows)


def test_very_long_text(documents, bench):
    text = "filler words " * 200_000 + "short item"
    assert tuple(D.report(documents([(1, text)]), bench).first())[1:4] == (400_002, 2, 1)


def test_large_benchmark_stays_compact():
    """2 MiB of benchmark, every window findable, in a few times its bytes."""
    r = random.Random(5)
    items = [(i, " ".join(str(r.randrange(10**6)) for _ in range(300))) for i in range(1000)] + [(5000, None), (5001, ""), (5002, "one two")]
    tracemalloc.start()
    known = D.Windows(items)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40 << 20
    probe = [items[7][1].upper(), items[7][1][:-1] + "x", "one  TWO", "two one", items[999][1][5:], None]
    spans, names = known.hits(Words(pa.array(probe)))
    assert names[0] == names[1] == {"7"} and names[2] == {"5002"} and names[4] == {"999"} and set(names) == {0, 1, 2, 4}
    assert D.merged(spans[0]) == [(0, 300)] and D.merged(spans[1]) == [(0, 299)]


def test_hashes_alone_decide_nothing(monkeypatch):
    """All hashes alike: every hit is told by its words."""
    monkeypatch.setattr(Words, "windows", lambda self, n: np.zeros(max(0, len(self.hashes) - n + 1), np.uint64))
    rows, items = case()
    known = D.Windows(items)
    spans, names = known.hits(Words(pa.array([t for _, t in rows], pa.string())))
    for i, (_, text) in enumerate(rows):
        n_hit = sum(b - a for a, b in D.merged(spans.get(i, [])))
        assert (n_hit, len(names.get(i, ()))) == brute(text, items)[1:3]


def test_windows_are_built_once_for_a_worker():
    items = [(1, "a b c")]
    one = D.built("t", items, 13)
    assert D.built("t", items, 13) is one and D.built("u", items, 13) is not one
