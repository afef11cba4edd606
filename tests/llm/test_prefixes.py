"""The prefix trie against a plain one of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm import prefixes as P


def in_order(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest(), (r, t)))
    return {c: [x[-1] for x in sorted(v)] for c, v in by.items()}


def borrowed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += p not in kids
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items())


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == cols
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos int, `a.b` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)


def crowd(seed=3):
    g = random.Random(seed)
    words = ["hé", "b" * 30, "", None, "c"]
    rows = []
    for c in range(-12, 160):
        n = g.choice([1, 2, 3, 8, 12])
        same = c % 3 == 0  # one very common conversation
        rows += [(c * (1 if c % 11 else 7), None if not same and g.random() < 0.1 else t, "user" if same else g.choice(["user", "bot", None]), "hello" if same else g.choice(words)) for t in range(9 if same else n)]
    rows += [(500, 3, "user", "x"), (500, 3, "user", "x"), (500, 3, "bot", "x"), (None, 0, "user", "lost"), (10**17, 0, None, None)]
    return rows


@pytest.mark.parametrize("run", [1024, 4])
def test_equals_plain_trie(spark, monkeypatch, run):
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "IDS", 7)
    rows = crowd()
    assert got(P.rebuilt_trie(frame(spark, rows))) == plain(borrowed(in_order(rows)))
    assert got(P.conversation_trie(frame(spark, rows))) == plain(in_order(rows))


def test_one_conversation_holds_most_turns(spark):
    """A conversation over many tasks and runs; its prefix and its copy."""
    long = [(7, t, "user", f"turn {t % 50}") for t in range(3000)]
    rows = long + [(8, t, r, x) for _, t, r, x in long] + [(9, t, r, x) for _, t, r, x in long[:2000]] + [(10, 0, "user", "z" * 300_000)]
    out = got(P.conversation_trie(frame(spark, rows, 5)))
    # plain sums are the square of the depth: counted by hand instead
    size = [len(x[3]) for x in long]
    assert len(out) == 3002
    by = {(r[0], r[1]): r for r in out}
    assert by[7, 0][2:7] == (-1, 4, 2, 2, sum(2 * s for s in size[:2000]) + sum(size[2000:]))
    assert by[7, 2000][3:7] == (3, 1, 1, 2 * size[1999] + sum(size[2000:]))
    assert by[7, 3000][3:] == (2, 0, 1, size[2999], hashlib.sha256(b"7,8").hexdigest())
    assert by[10, 1][2:] == (7, 1, 0, 1, 0, hashlib.sha256(b"10").hexdigest())
    assert by[7, 2000][7] == hashlib.sha256(b"9").hexdigest() and by[7, 1][7] == hashlib.sha256().hexdigest()


def test_edges(spark):
    assert got(P.rebuilt_trie(frame(spark, []))) == []
    # turnless: 3 loses its only turn and its base is absent
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert got(P.rebuilt_trie(frame(spark, [(c, 0, "user", "x")]))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_node_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")]
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "bot", "b"), (2, 1, "user", "a")], "conv long, pos long, role string, text string")
    out = {(r["conv_id"], r["depth"]): r["text"] for r in P.node_turns(P.conversation_trie(frame(spark, rows)), turns).collect()}
    assert out == {(1, 0): None, (1, 1): "a", (1, 2): "b"}
