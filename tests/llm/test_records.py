"""Records: ids equal the library's, exact round trip, offsets, damage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import records as R
from quire.llm.queries import tokenizer_path

PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", ".", ",", "é", "中", "’", "'", "'s", "1", "<|endoftext|>", "\r\n", "\x0b", "　", "\x1c", "\x85", " ", " w", " The", "(x)", "😀"]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_librarys(tok):
    r = random.Random(5)
    rows = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    rows += ["".join(r.choice(["a", "b", " c", ".", "\n", "é", " D", "'t", "9"]) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    rows += [None, "", " ", "a ", " a", "x" * 5000]
    enc = R.Encoder(tokenizer_path())
    assert enc.by_word
    got = [x.tolist() for k in range(0, len(rows), 500) for x in enc.of(pa.array(rows[k : k + 500], pa.string()))]
    assert got == [e.ids for e in tok.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_full_cache_is_emptied(tok, monkeypatch):
    monkeypatch.setattr(R, "CACHE_PIECES", 20)
    enc = R.Encoder(tokenizer_path())
    for k in range(20):
        texts = [f"word{k} other{i} Word{i}, x{k * i}" for i in range(9)]
        assert [x.tolist() for x in enc.of(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


ROWS = [(7, "seven"), (3, None), (3, "three times"), (3, ""), (None, "no id"), (-5, "below"), (10, "ten " * 30_000), (11, "é\n\n ü")]


def test_learnt_pieces_stay_small():
    """What an idle worker keeps of the pieces it has seen: arrays, no Python objects."""
    import tracemalloc

    enc, n = R.Encoder(tokenizer_path()), 30_000
    enc.of(pa.array(["warm up"]))
    texts = pa.array([" ".join(f"w{i}x" for i in range(k, k + 1000)) for k in range(0, n, 1000)])
    tracemalloc.start()
    enc.of(texts)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(enc.place) >= n
    assert kept < 80 * n


def test_round_trip(documents, spark, tok, tmp_path):
    folder = str(tmp_path / "out")
    manifest = R.write_records(documents(ROWS), folder, tokenizer_path())
    rows = sorted((tuple(r) for r in R.read_records(manifest, folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [r[:4] for r in rows] == want
    for file in manifest.collect():  # a shuffled reader's way
        index = np.fromfile(file["path"].replace(".rec", ".idx"), "<i8").reshape(-1, 3)
        assert len(index) == file["records"]
        for offset, i, n in index[::-1].tolist():
            got, ids = R.read_at(file["path"], offset)
            assert (R.NONE if got is None else got) == i and len(ids) == n and ids[-1] == 2


def test_damage_is_found(documents, tmp_path):
    folder = tmp_path / "out"
    manifest = R.write_records(documents([(1, "some text here")]), str(folder), tokenizer_path())
    path = manifest.first()["path"]
    raw = bytearray(open(path, "rb").read())
    for at in (0, 9, 20, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match="damaged"):
            R.read_records(manifest, str(folder)).collect()


def test_empty_table(documents, spark):
    assert R.records_report(documents(ROWS).limit(0), tokenizer_path()).count() == 0
