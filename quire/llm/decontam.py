"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised
word n-grams; every window of every whole text is looked up, hits are verified
word by word, and documents or the hit spans are removed.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII
capitals lowered. An item's windows are its runs of 13 words; an item of fewer
words, but not none, is one window. A document is contaminated if at least 5% of its
words, and at least one, lie inside an occurrence of a window.

Defined results: null and empty texts have no words and are clean; null items have
no windows; items without an item_id hit, but are named in no list; equal items and
repeated rows count once per item_id and once per document row. Input columns stay
as they are; ``decontaminated`` returns exactly the input's columns.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, col, need, own
from quire.llm.words import Words, portions

WINDOW = 13
SHARE = 20  # contaminated when SHARE * hit words >= words
MAX_BROADCAST_BYTES = 16 << 20
SEEN_BITS = 22
KNOWN = 100_000  # verified windows a worker remembers; others are read from the bytes again


class Windows:
    """Every window of some benchmark items: by length, the sorted hashes of all windows
    and where each starts, over the items' own bytes. About 12 bytes a window and 8 a
    word stand beside the text; no Python object is kept for a window."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        w = Words(pa.array([t for _, t in items], pa.string()))
        self.names = [None if item is None else str(item) for item, _ in items]
        self.first, self.by_length, self.seen = w.first, {}, {}
        rows, held = w.rows(), np.minimum(w.counts, n)
        for size in np.unique(held[held > 0]).tolist():
            at = np.flatnonzero((rows[: len(rows) - size + 1] == rows[size - 1 :]) & (held[rows[: len(rows) - size + 1]] == size)).astype(np.int32)
            hashes = w.windows(size)[at]
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], at[order]
            self.seen[size] = np.zeros(1 << SEEN_BITS, bool)
            self.seen[size][hashes >> np.uint64(64 - SEEN_BITS)] = True
        w.hashes, w.starts, w.ends = None, w.starts.astype(np.int32), w.ends.astype(np.int32)
        self.text = Text(w)
        self.known = lru_cache(maxsize=KNOWN)(self._known)

    def _known(self, size: int, low: int) -> dict[bytes, set[str]]:
        """The windows whose hash stands at ``low``: words -> names of their items."""
        hashes, starts = self.by_length[size]
        out: dict[bytes, set[str]] = {}
        for at in starts[low : np.searchsorted(hashes, hashes[low], side="right")].tolist():
            names = out.setdefault(self.text.words(at, size), set())
            name = self.names[int(np.searchsorted(self.first, at, side="right")) - 1]
            if name is not None:
                names.add(name)
        return out

    def hits(self, w: Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set]]:
        """By row: spans (first word, end word) of verified occurrences, and items."""
        spans, items, folded, rows = defaultdict(list), defaultdict(set), Text(w), w.rows()
        for size, (hashes, _) in self.by_length.items():
            h = w.windows(size)
            at = np.flatnonzero(self.seen[size][h >> np.uint64(64 - SEEN_BITS)])
            at = at[rows[at] == rows[at + size - 1]]
            low = np.searchsorted(hashes, h[at])
            found = hashes[np.minimum(low, len(hashes) - 1)] == h[at]
            for x, k in zip(at[found].tolist(), low[found].tolist(), strict=True):
                names = self.known(size, k).get(folded.words(x, size))
                if names is not None:
                    row = int(rows[x])
                    start = x - int(w.first[row])
                    spans[row].append((start, start + size))
                    items[row] |= names
        return spans, items


#: The windows of the slice a worker saw last: its next task need not build them anew.
_built: dict[str, Windows] = {}


def built(token: str, items: list[tuple[object, str | None]], window: int) -> Windows:
    if token not in _built:
        _built.clear()
        _built[token] = Windows(items, window)
    return _built[token]


class Text:
    """The folded words behind the hashes, for verification."""

    def __init__(self, w: Words):
        self.w = w

    def words(self, at: int, n: int) -> bytes:
        w = self.w
        return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[at : at + n], w.ends[at : at + n], strict=True)).lower()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slices(bench: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in slices of at most about ``most`` bytes (one longer item is alone)."""
    rows = bench.select(col(item).cast("string").alias("item"), col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, int(-(-total // most)))  # an empty benchmark is one empty slice
    for k in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in mine.collect()]


def scanned(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned): n_words, n_hit, spans
    (array of merged [first word, end word)), items (sorted). The benchmark's size is
    measured; above ``max_broadcast_bytes`` it goes in slices, one narrow pass each."""
    need(docs, text)
    need(bench, item, item_text)
    found = own("hits")
    kind = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
    out = docs.withColumn(found, F.lit(None).cast(kind))
    spark = docs.sparkSession
    for items in slices(bench, item, item_text, max_broadcast_bytes):
        shared, token = spark.sparkContext.broadcast(items), own("windows")

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            known = built(token, shared.value, window)
            for batch in batches:
                for part in portions(batch, text):
                    w = Words(part.column(part.schema.get_field_index(text)))
                    spans, names = known.hits(w)
                    before = part.column(part.num_columns - 1)
                    rows = []
                    for i, n in enumerate(w.counts.tolist()):
                        old = before[i].as_py() if before[i].is_valid else {"spans": [], "items": []}
                        all_spans = merged([(x["a"], x["b"]) for x in old["spans"]] + spans.get(i, []))
                        rows.append({"n_words": n, "n_hit": sum(b - a for a, b in all_spans), "spans": [{"a": a, "b": b} for a, b in all_spans], "items": sorted(names.get(i, set()) | set(old["items"]))})
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, arrow)], names=part.schema.names)

        out = arrow_map(out, scan, out.schema)
    return out, found


def report(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    need(docs, doc_id)
    out, found = scanned(docs.select(col(doc_id).alias("doc_id"), col(names.get("text", "text")).cast("string").alias("text")), bench, **{k: v for k, v in names.items() if k != "text"})
    x = F.col(found)
    return out.select("doc_id", x.n_words.alias("n_words"), x.n_hit.alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(x["items"], ",").cast("binary"), 256).alias("items_sha256"), ((x.n_hit > 0) & (SHARE * x.n_hit >= x.n_words)).alias("contaminated"))


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", remove: str = "documents", **names) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with the
    hit word spans cut out of their texts and every document kept ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    out, found = scanned(docs, bench, text, **names)
    if remove == "documents":
        return out.where(~((F.col(found).n_hit > 0) & (SHARE * F.col(found).n_hit >= F.col(found).n_words))).drop(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, text):
                i = part.schema.get_field_index(text)
                w, texts = Words(part.column(i)), part.column(i).to_pylist()
                for row, hit in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if hit["spans"]:
                        raw, base, first = texts[row].encode(), int(_start(part.column(i), row)), int(w.first[row])
                        for x in reversed(hit["spans"]):
                            raw = raw[: w.starts[first + x["a"]] - base] + raw[w.ends[first + x["b"] - 1] - base :]
                        texts[row] = raw.decode()
                columns = list(part.columns)
                columns[i] = pa.array(texts, part.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(columns[:-1], names=part.schema.names[:-1])

    return arrow_map(out, cut, docs.schema)


def _start(column: pa.Array, row: int) -> int:
    from quire.llm.words import text_bytes

    return text_bytes(column)[1][row]


#: DuckDB: the contract's report, from string windows.
REPORT_SQL = """
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') w from documents),
items as (
  select distinct cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') w from benchmark where text is not null),
windows as (
  select distinct item, least(13, len(w)) n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) s from items where len(w) > 0),
sizes as (select distinct n from windows),
spans as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) s from lowered, sizes where len(w) >= n),
hits as (select doc_id, i, spans.n, item from spans join windows on spans.s = windows.s and spans.n = windows.n),
hit_words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
hit_items as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) names from hits group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from lowered left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
