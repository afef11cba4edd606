"""Array kernels over the bytes of an Arrow text column: word hashes, word
windows and shingle multisets without one Python object per word.

A word is a run of ASCII letters, digits and non-ASCII characters; ASCII capitals
are lowered. Work goes in pieces, so memory follows the piece, not the text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95
U = np.uint64

FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        FOLD[_c] = _c
    elif 65 <= _c <= 90:
        FOLD[_c] = _c + 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (base odd)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def grown(n: int) -> int:
    return max(PIECE, 1 << (max(n, 1) - 1).bit_length())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets; null is empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def portions(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text; a longer row is alone."""
    i = batch.schema.get_field_index(text)
    off = text_bytes(batch.column(i))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a text column: ``hashes``, byte ``starts``/``ends`` and, by row,
    the first word (``first`` has one entry more than there are rows)."""

    def __init__(self, column: pa.Array, heads: tuple[int, ...] = ()):
        data, off = text_bytes(column)
        self.data = data
        hashes, starts, ends, tops = [], [], [], [[] for _ in heads]
        lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
        at = lo
        while at < hi:
            end = min(hi, at + PIECE)
            while end < hi and FOLD[data[end]] and FOLD[data[end - 1]] and not self._row_start(off, end):
                nxt = np.flatnonzero(FOLD[data[end : min(hi, end + PIECE)]] == 0)
                end = end + int(nxt[0]) if len(nxt) else min(hi, end + PIECE)
            b = FOLD[data[at:end]]
            inside = b != 0
            cut = np.zeros(len(b) + 1, bool)
            cut[0] = cut[-1] = True
            rows = off[np.searchsorted(off, at) : np.searchsorted(off, end, side="right")]
            cut[rows - at] = True
            s = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
            e = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
            up, down = powers(BASE, grown(len(b)))
            total = np.zeros(len(b) + 1, U)
            np.cumsum(b * up[: len(b)], out=total[1:])
            low = total[s]
            hashes.append(mix((total[e] - low) * down[s] + (e - s).astype(U)))
            for k, n in enumerate(heads):
                tops[k].append(mix((total[np.minimum(s + n, e)] - low) * down[s] + U(n + 101)))
            starts.append(s + at)
            ends.append(e + at)
            at = end
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hashes, self.starts, self.ends = cat(hashes, U), cat(starts, np.int64), cat(ends, np.int64)
        self.heads = [cat(t, U) for t in tops]
        self.first = np.searchsorted(self.starts, off) if len(off) else np.zeros(1, np.int64)
        self.counts = np.diff(self.first)

    @staticmethod
    def _row_start(off: np.ndarray, at: int) -> bool:
        i = int(np.searchsorted(off, at))
        return i < len(off) and off[i] == at

    def windows(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on (may run past the row's end:
        see ``whole``); n words longer than all is empty."""
        m = len(self.hashes)
        if m < n:
            return np.zeros(0, U)
        up, down = powers(STEP, grown(m + 1))
        total = np.zeros(m + 1, U)
        np.cumsum(self.hashes * up[:m], out=total[1:])
        return mix((total[n:] - total[: m - n + 1]) * down[: m - n + 1] + U(n))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def row_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each row's whole word sequence."""
        out = []
        for base, salt in ((STEP, 0), (BASE, 0x5851F42D4C957F2D)):
            h = mix(self.hashes ^ U(salt)) if salt else self.hashes
            up, down = powers(base, grown(len(h) + 1))
            total = np.zeros(len(h) + 1, U)
            np.cumsum(h * up[: len(h)], out=total[1:])
            f = self.first
            out.append(mix((total[f[1:]] - total[f[:-1]]) * down[f[:-1]] + self.counts.astype(U)))
        return out[0], out[1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
