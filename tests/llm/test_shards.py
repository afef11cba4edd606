"""Shards: whole groups, near equal bytes, gapless slots."""

import random
import zlib
from collections import defaultdict

import pytest

from quire.llm import shards as S


def check(rows, got, n):
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got) == sorted(i if i is not None else -1 for i, _ in rows)
    by_id = dict(rows)
    slots, where, size = defaultdict(list), {}, defaultdict(int)
    for r in got:
        t = by_id[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert (r["law"], r["grown_shard"]) == ("bytes", None) and 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault(t, r["shard"]) == r["shard"]
        size[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [size[k] for k in range(n)]


def test_many_documents_with_copies(documents):
    r = random.Random(2)
    rows = [(i, "x" * r.choice([0, 3, 40, 900]) + str(i)) for i in range(3000)]
    rows += [(10_000 + i, "a copy" * 3) for i in range(700)] + [(20_000, None), (20_001, ""), (20_002, None), (None, "n")]
    size = check(rows, S.sharded(documents(rows)).collect(), 16)
    assert max(size) - min(size) < 0.01 * sum(size)


def test_a_group_above_the_mean_stands_alone(documents):
    rows = [(i, "hot" * 50) for i in range(400)] + [(1000 + i, f"text {i} " * 5) for i in range(600)]
    got = S.sharded(documents(rows)).collect()
    size = sorted(check(rows, got, 16))
    rest = size[:-1]
    assert size[-1] == 400 * 151 and max(rest) - min(rest) < 0.2 * max(rest)


def test_few_rows_repeats_and_none(documents):
    rows = [(1, "a"), (1, "a"), (2, "b")]
    got = S.sharded(documents(rows)).collect()
    check(rows, got, 16)
    assert sorted(r["slot"] for r in got if r["doc_id"] == 1) == [0, 1]
    assert S.sharded(documents(rows).limit(0)).count() == 0


def test_packing_equals_plain_best_fit():
    r = random.Random(7)

    def plain(sizes, bins, capacity):
        free, out = [capacity] * bins, {}
        for s, i in sizes:
            fits = [(f, b) for b, f in enumerate(free) if f >= s]
            if not fits:
                return None
            f, b = min(fits)
            free[b] -= s
            out[i] = b
        return out

    for _ in range(200):
        sizes = sorted(((r.randint(1, 30), i) for i in range(r.randint(1, 30))), key=lambda x: (-x[0], x[1]))
        bins, capacity = r.randint(1, 6), r.randint(20, 90)
        got = S.best_fit(sizes, bins, capacity)
        assert (got and dict(got)) == plain(sizes, bins, capacity)


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_as_tight_as_best_fit_can(seed):
    r = random.Random(seed)
    sizes = {i: r.randint(1, 50) for i in range(200)}
    where = S.pack(sizes, 8)
    load = [sum(s for i, s in sizes.items() if where[i] == b) for b in range(8)]
    assert max(load) <= sum(sizes.values()) / 8 + 50 and set(where) == set(sizes)
