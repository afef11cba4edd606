"""Array kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from quire.llm import words as W

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    return PATTERN.findall((text or "").translate(LOWER))


def texts(n=400, seed=1):
    r = random.Random(seed)
    made = ["".join(r.choice(["a", "B", " ", ".", "é", "É", "\n", "7", "中", "x y"]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*made, None, "", "...", "one", "A" * (3 * W.PIECE) + " tail", "\x00a\x7fb"]


def test_words_hash_alike_exactly_if_equal():
    rows = texts()
    w = W.Words(pa.array(rows, pa.string()))
    flat = [x for t in rows for x in plain(t)]
    assert [len(plain(t)) for t in rows] == w.counts.tolist()
    known = {}
    for word, h in zip(flat, w.hashes.tolist(), strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_and_portions_give_the_same():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts(), pa.string())})
    whole = W.Words(batch.column(0))
    parts = list(W.portions(batch, "text", most=50))
    assert sum(p.num_rows for p in parts) == batch.num_rows and len(parts) > 10
    assert np.array_equal(np.concatenate([W.Words(p.column(0)).hashes for p in parts]), whole.hashes)


def test_windows_and_rows_hash_by_content():
    w = W.Words(pa.array(["a b c a b", "b c", "b c", "", None, "c b"]))
    x = w.windows(2)
    assert x[0] == x[3] and x[1] == x[5] == x[7] and len(set(x[[0, 1, 2]].tolist())) == 3
    one, two = w.row_hashes()
    assert one[1] == one[2] != one[5] and two[1] == two[2] != two[5] and one[3] == one[4]
