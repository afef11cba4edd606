"""Token-ID binary output: length-delimited records and a separate offset index.

File format, little-endian. A record file (``part-*.rec``) is a run of frames

    uint64 payload bytes | uint32 masked crc32 of those 8 bytes
    payload              | uint32 masked crc32 of the payload

with mask(c) = rotate right by 15 bits, plus 0xA282EAD8. A payload is int64 doc_id, one
byte of width (2 or 4: bytes of an id), then the ids, the end id last. Beside it,
``part-*.idx`` holds for every record int64 offset of its frame, int64 doc_id and
int64 number of ids: a shuffled reader opens any record by one seek.

``write_records`` range-partitions by doc_id, so files and records ascend in doc_id, and
encodes inside the tasks. A task writes under a name of its own attempt; the manifest
that Spark commits names the files that count, so a lost or repeated task leaves at
most unnamed files. Paths go through ``pyarrow.fs``, so any store it knows will do.

Defined results: null text is encoded as empty (the end id alone); rows repeating a
doc_id are all written, ordered by text; a null doc_id is written as the least long,
first, and read back as null; an empty table gives no records.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, lean, need, staged
from quire.llm.words import BASE, PIECE, U, grown, mix, portions, powers, text_bytes
from quire.session import shared_dir

END = 2
NONE = -(1 << 63)
HEAD = np.dtype([("size", "<u8"), ("crc", "<u4")])
CACHE_PIECES = 500_000  # some 16 MB a worker, which an idle one keeps
FILES = "part string, path string, records bigint, tokens bigint, bytes bigint"


def masked(c: int) -> int:
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(zlib.crc32(size)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


class Encoder:
    """Ids of whole texts, from the tokenizers library. A byte-level tokenizer encodes
    what lies between spaces, or between ASCII letters and punctuation, each alone. So the
    distinct pieces of a portion are found by hash, new ones are encoded, many in a text,
    and kept in a bounded cache, and the texts' ids are gathered from it. A text with
    doubled or odd white space or a special token's string, and any tokenizer that a probe
    shows to work otherwise, is encoded as it is."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.leads = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.leads[i] = token.startswith("Ġ")
        self.line = self._plain("\n")
        self.by_word = self._splits_so()
        self._forget()

    def _forget(self) -> None:
        self.names, self.place = np.zeros(0, U), np.zeros(0, np.int64)  # words' hashes in order, and their numbers
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.ends = np.zeros(1 << 14, np.int64)  # word n has ids[ends[n]:ends[n + 1]]

    def _splits_so(self) -> bool:
        probe = "Ab c's, (d1) 2e, f.g\nh; I\téß. 中文 \U0001f600!"
        data = np.frombuffer(probe.encode(), np.uint8)
        pieces = zip(*pieces_of(data, np.array([0, len(data)]), np.zeros(1, bool)), strict=True)
        alone = [i for a, b, lead in pieces for i in self._plain(" " * bool(lead) + data[a:b].tobytes().decode())]
        return self.tok.normalizer is None and alone == self._plain(probe) and int(self.leads.sum()) > 1 and len(self.line) == 1

    def _plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of every row of a text column; null is empty."""
        data, off = text_bytes(column)
        low = int(off[0]) if len(off) else 0
        off = off - low
        data = data[low : low + int(off[-1])] if len(off) else data
        odd = odd_rows(data, off, self.special) if self.by_word else np.ones(len(column), bool)
        out = [np.zeros(0, self.kind)] * len(column)
        if not odd.all():
            starts, ends, lead = pieces_of(data, off, odd)
            word = self._numbers(data, starts, ends, hashed(data, starts, ends, lead), lead)
            first = np.searchsorted(starts, off)
            size = self.ends[word + 1] - self.ends[word]
            upto = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.arange(upto[-1]) + np.repeat(self.ends[word] - upto[:-1], size)]
            out = [ids[upto[x] : upto[y]] for x, y in zip(first[:-1], first[1:])]  # noqa: B905
        for i in np.flatnonzero(odd):
            out[i] = np.array(self._plain(data[off[i] : off[i + 1]].tobytes().decode()), self.kind)
        return out

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The number of every piece."""
        if len(self.place) > CACHE_PIECES:
            self._forget()
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        got = np.full(len(unique), -1)
        spot = np.searchsorted(self.names, unique)
        old = np.flatnonzero(spot < len(self.names))
        old = old[self.names[spot[old]] == unique[old]]
        got[old] = self.place[spot[old]]
        for kind, gap, glue in ((True, self.leads, b" "), (False, None, b"\n")):
            new = np.flatnonzero((got < 0) & (lead[at] == kind))
            raw = [data[a:b].tobytes() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            got[new] = self._learn(unique[new], raw, gap, glue)
        return got[back]

    def _learn(self, names: np.ndarray, raw: list[bytes], leads: np.ndarray | None, glue: bytes) -> np.ndarray:
        """Encode new pieces, 200 in a text: each begins at an id that leads with the
        space between them, or they stand between the ids of single line ends."""
        groups = [raw[k : k + 200] for k in range(0, len(raw), 200)]
        joined = [(b" " * (leads is not None) + glue.join(g)).decode() for g in groups]
        flat, sizes = [], []
        for group, enc in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, self.kind)
            if leads is not None:
                cut = np.flatnonzero(leads[ids])
                size = np.diff(np.append(cut, len(ids)))
                fits = len(cut) == len(group) and cut[0] == 0
            else:
                cut = np.flatnonzero(ids == self.line[0])
                size = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
                fits = len(size) == len(group) and all(size) and not any(b"\n" in g for g in group)
                ids = ids[ids != self.line[0]] if fits else ids
            if not fits:
                alone = [np.array(self._plain((b" " * (leads is not None) + g).decode()), self.kind) for g in group]
                ids, size = np.concatenate(alone), np.array([len(x) for x in alone])
            flat.append(ids)
            sizes.append(size)
        n = len(self.place)
        numbers = np.arange(n, n + len(names))
        if len(names):
            self._keep(np.concatenate(flat), np.concatenate(sizes), n)
            spot = np.searchsorted(self.names, names)
            self.names, self.place = np.insert(self.names, spot, names), np.insert(self.place, spot, numbers)
        return numbers

    def _keep(self, flat: np.ndarray, sizes: np.ndarray, n: int) -> None:
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.ends) < n + len(sizes) + 1:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(flat)


def pieces_of(data: np.ndarray, off: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the pieces of each row that is not odd, and which have a space before
    them: cut at spaces, between an ASCII letter or digit and ASCII punctuation (but the
    apostrophe), and before and after a line end that stands alone."""
    mark = np.zeros(len(data), bool)
    kind, line, white = CLASS[data], data == 10, ODD[data]
    mark[1:] |= (kind[1:] + kind[:-1]) == 3
    alone = line.copy()
    alone[1:] &= ~white[:-1]
    alone[:-1] &= ~white[1:]
    mark[1:] |= alone[:-1] | (line[1:] & ~white[:-1])
    mark[1:] |= data[:-1] == 32
    mark[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(mark)
    row = np.searchsorted(off, starts, side="right") - 1
    starts, row = starts[~odd[row]], row[~odd[row]]
    first = np.ones(len(starts), bool)
    first[1:] = row[1:] != row[:-1]
    lead = (data[np.maximum(starts - 1, 0)] == 32) & ~first
    ends = off[row + 1].copy()
    ends[:-1] = np.where(first[1:], ends[:-1], starts[1:] - lead[1:])
    return starts, ends, lead


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk's bytes, length and place (never 0), piece by piece."""
    out, at = np.zeros(len(starts), U), 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        b = data[starts[at] : ends[last - 1]].astype(U) + U(1)
        up, down = powers(BASE, grown(len(b) + 1))
        total = np.zeros(len(b) + 1, U)
        np.cumsum(b * up[: len(b)], out=total[1:])
        s, e = starts[at:last] - starts[at], ends[at:last] - starts[at]
        out[at:last] = mix(mix((total[e] - total[s]) * down[s]) + (e - s).astype(U) * U(2) + head[at:last])
        at = last
    return np.maximum(out, 1)


def odd_rows(data: np.ndarray, off: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Rows that begin or end with a space, have a space beside other white space,
    white space beyond ASCII, or a special token's string."""
    bad = np.zeros(len(data), bool)
    space, white = data == 32, ODD[data]
    bad[1:] |= (space[1:] & white[:-1]) | (white[1:] & space[:-1])
    for lead in ODD_LEADS:
        at = np.flatnonzero(data == lead)
        at = at[at + 2 < len(data) + (lead == 0xC2)]
        second = data[at + 1]
        third = data[np.minimum(at + 2, len(data) - 1)]
        if lead == 0xC2:
            hit = (second == 0x85) | (second == 0xA0)
        elif lead == 0xE1:
            hit = (second == 0x9A) & (third == 0x80)
        elif lead == 0xE2:
            hit = (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F)
        else:
            hit = (second == 0x80) & (third == 0x80)
        bad[at[hit]] = True
    some = np.flatnonzero(np.diff(off))
    bad[off[some]] |= space[off[some]]
    bad[off[some + 1] - 1] |= space[off[some + 1] - 1]
    raw = data.tobytes() if special else b""
    for token in special:
        at = raw.find(token)
        while at >= 0:
            bad[at] = True
            at = raw.find(token, at + 1)
    # a space and white space on two sides of a row's end is no harm, only slower
    return np.diff(np.concatenate(([0], np.cumsum(bad)))[off]) > 0


#: ASCII white space, a space included.
ODD = np.zeros(256, bool)
ODD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: 1 for ASCII letters and digits, 2 for ASCII punctuation but the apostrophe.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 2
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
CLASS[39] = 0
#: First bytes of white space beyond ASCII.
ODD_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Write record and index files under ``folder`` and return the manifest (part,
    path, records, tokens, bytes), parts in ascending doc_id order. ``tokenizer`` is
    the path of a tokenizers file that every executor has."""
    from pyarrow import fs

    need(docs, doc_id, text)
    lean(docs.sparkSession)
    where, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    where.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}"
        enc, store = encoder(tokenizer), None
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        path = f"{base}/{name}.rec"
        n = tokens = at = 0
        out = index = None
        for batch in batches:
            for some in portions(batch, "text", 2 << 20):
                if out is None:
                    out, index = store.open_output_stream(path), store.open_output_stream(f"{base}/{name}.idx")
                ids = some.column(0).fill_null(NONE).to_pylist()
                tail, frames, entries = np.array([end], enc.kind).tobytes(), [], []
                for i, found in zip(ids, enc.of(some.column(1)), strict=True):
                    raw = found.tobytes() + tail
                    made = frame(i.to_bytes(8, "little", signed=True) + bytes([enc.width]) + raw)
                    frames.append(made)
                    entries.append((at, i, len(raw) // enc.width))
                    at += len(made)
                    tokens += len(raw) // enc.width
                n += len(ids)
                out.write(b"".join(frames))
                index.write(np.array(entries, "<i8").tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [f"{part:07d}"], "path": [path], "records": [n], "tokens": [tokens], "bytes": [at]})

    rows = docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return staged(rows.mapInArrow(write, FILES), "manifest")


def frames(stream, size: int) -> Iterator[bytes]:
    """Payloads of a record file; a wrong length or checksum raises ValueError."""
    at = 0
    while at < size:
        head = stream.read(12)
        n = int.from_bytes(head[:8], "little")
        if len(head) != 12 or masked(zlib.crc32(head[:8])) != int.from_bytes(head[8:], "little"):
            raise ValueError(f"damaged frame header at {at}")
        body = stream.read(n + 4)
        if len(body) != n + 4 or masked(zlib.crc32(body[:n])) != int.from_bytes(body[n:], "little"):
            raise ValueError(f"damaged payload at {at}")
        yield body[:n]
        at += n + 16


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    i = int.from_bytes(payload[:8], "little", signed=True)
    return (None if i == NONE else i), np.frombuffer(payload, f"<u{payload[8]}", offset=9)


def read_at(folder_file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by the offset that the index gives."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder_file if "://" in folder_file else f"file://{folder_file}")
    with store.open_input_file(path) as f:
        f.seek(offset)
        return ids_of(next(frames(f, 1)))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the manifest's files, from the files: doc_id, start
    (ids of all records before it), n_tokens, ids_crc32 (of the ids as uint32), part.
    The running start of each file comes from the manifest, one row for each file."""
    from pyarrow import fs

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for file in batch.to_pylist():
                start, rows, seen = file["start"], [], 0
                with store.open_input_stream(file["path"], buffer_size=1 << 20) as f:
                    for payload in frames(f, file["bytes"]):
                        i, ids = ids_of(payload)
                        rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), file["part"]))
                        start += len(ids)
                        seen += 1
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if seen != file["records"] or start - file["start"] != file["tokens"]:
                    raise ValueError(f"{file['path']} does not hold what the manifest says")
                yield _rows(rows)

    # a given number of partitions: a manifest's few bytes must not make one task of all files
    files = files.repartition(max(1, manifest.count())).select("part", "path", "records", "tokens", "bytes", "start")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "n_tokens", "ids_crc32", "part"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.string())]))


def records_report(docs: DataFrame, tokenizer: str, folder: str | None = None, **names) -> DataFrame:
    """Write all of ``docs`` as records and report what the files hold."""
    folder = folder or shared_dir(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer, **names), folder)
