"""Language identification by compression: a text is encoded with one zstandard
raw-content dictionary for each language, and the language of the smallest code wins.

Both sides are first reduced to lower-case letters with one blank between words, so
case, digits, addresses and punctuation tell nothing. A text goes in pieces of PIECE
bytes, each encoded alone: a long text never becomes its own dictionary, and the sums
of sizes of the whole text are compared. A text shorter than REPEAT bytes is repeated
up to there, because zstandard stores very short input unencoded, at one size for all.

A dictionary is learnt from a bounded sample of labelled rows: of the LANGUAGES languages
with the most labelled rows, up to ROWS rows chosen by the hash of their id, and of each a slice of
SLICE characters at a hashed place; DICTIONARY bytes of the distinct slices make the
dictionary. Nothing else is learnt, and every whole text is scored.

``score`` is the winner's share when each language weighs 2 to the power of minus its
bytes. ``margin`` is by how many parts of the second smallest code the smallest is
shorter; ``rejected`` marks margins under ``min_margin``.

Defined results: null text, and text without a letter, is ``und`` with score and margin 0,
not rejected; so is every text where no language was learnt. Equal sizes go to the
language with more labelled rows, then to the lesser name; one learnt language alone gets every
text with letters, with score and margin 1. Labels that are null teach nothing. A null
doc_id counts as the empty string in hashes. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import arrow_map, col, need, own, staged
from quire.llm.words import portions

LANGUAGES = 256
ROWS = 512
SLICE = 1000
DICTIONARY = 112 << 10
PIECE = 2048
REPEAT = 512
MIN_MARGIN = 0.02
FOLD = 5
UNKNOWN = "und"

_GAPS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def reduced(text: str | None) -> bytes:
    """Lower-case words between single blanks, or nothing for a text without a letter."""
    if text is None or not _LETTER.search(text):
        return b""
    return f" {_GAPS.sub(' ', text.lower()).strip()} ".encode()


@dataclass
class Languages:
    """Learnt languages, those with the most labelled rows first, and their dictionaries."""

    names: list[str] = field(default_factory=list)
    dictionaries: list[bytes] = field(default_factory=list)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.dictionaries:
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=4, write_checksum=0, write_content_size=0, write_dict_id=0)
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        return out


def sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes of the whole reduced text under each dictionary."""
    if 0 < len(text) < REPEAT:
        text = text * -(-REPEAT // len(text))
    pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], np.int64)


def judged(sizes: np.ndarray) -> tuple[int, float, float]:
    """(place of the least, its share, its margin)."""
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return best, 1.0, 1.0
    second = int(np.delete(sizes, best).min())
    return best, float(1 / np.exp2(-np.minimum(sizes - sizes[best], 1000).astype(float)).sum()), float((second - sizes[best]) / second)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLD == 0


def learnt(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", languages: int = LANGUAGES, rows: int = ROWS, dictionary: int = DICTIONARY) -> Languages:
    """Dictionaries of the languages of ``docs`` (all rows that are given, labelled or not)."""
    need(docs, doc_id, text, lang)
    key = F.xxhash64(F.coalesce(col(doc_id).cast("string"), F.lit("")))
    known = docs.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(lang).cast("string").alias("lang"), key.alias("key"), col(text).cast("string").alias("text"))
    counts = staged(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages), "languages")
    names = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").collect()]
    # the rows are picked by narrow columns, their texts are read afterwards; a language's share of
    # twice the rows wanted is taken by hash first, so one task sorts so few at any table size
    order = Window.partitionBy("lang").orderBy("key")
    few = known.select("lang", "key").join(F.broadcast(counts), "lang").where(F.pmod("key", F.lit(1 << 40)) * F.col("n") < F.lit(2 * rows) * F.lit(float(1 << 40)))
    picked = few.select("lang", "key").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    picked = staged(picked.select("lang", "key").distinct(), "language-sample", few=True)
    at = F.pmod(F.xxhash64("key", F.lit("slice")), F.greatest(F.length("text") - SLICE, F.lit(0)) + 1).cast("int") + 1
    slices = known.join(F.broadcast(picked), ["lang", "key"]).select("lang", "key", F.substring("text", at, F.lit(SLICE)).alias("slice"))
    numbered = slices.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "slice"))).where(F.col("n") <= rows)
    found: dict[str, dict[bytes, None]] = {name: {} for name in names}
    for r in numbered.orderBy("lang", "n").select("lang", "slice").toLocalIterator():
        found[r["lang"]][reduced(r["slice"]).strip()] = None
    out = Languages()
    for name in names:
        content = b" ".join([b"", *(s for s in found[name] if s), b""])[:dictionary]
        if content.strip():
            out.names.append(name)
            out.dictionaries.append(content)
    return out


@lru_cache(maxsize=1)
def _compressors(shared) -> list[zstandard.ZstdCompressor]:
    """A worker's compressors of a broadcast model."""
    return shared.value.compressors()


def identified(docs: DataFrame, model: Languages, text: str = "text", min_margin: float = MIN_MARGIN, prefix: str = "lang_") -> DataFrame:
    """``docs`` with, for every whole text, ``lang_pred``, ``lang_score``, ``lang_margin`` and
    ``lang_rejected`` (columns of those names are replaced; ``prefix`` is a parameter)."""
    need(docs, text)
    added = [prefix + x for x in ("pred", "score", "margin", "rejected")]
    rest = docs.drop(*(x for x in added if x != text))
    at, shared = rest.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, compressors = shared.value.names, _compressors(shared)
        for batch in batches:
            for part in portions(batch, text):
                found = []
                for x in part.column(at):
                    known = reduced(x.as_py()) if names else b""
                    if not known:
                        found.append((UNKNOWN, 0.0, 0.0, False))
                        continue
                    best, score, margin = judged(sizes(known, compressors))
                    found.append((names[best], score, margin, margin < min_margin))
                new = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)] if found else []
                if found:
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])

    return arrow_map(rest, run, schema)


def confident(docs: DataFrame, model: Languages, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with one more column ``lang_pred``: the language, ``und`` where the margin is narrow."""
    out = identified(docs.drop("lang_pred"), model, text, min_margin, p := own("lang") + "_")
    pred = F.when(col(p + "rejected"), F.lit(UNKNOWN)).otherwise(col(p + "pred")).alias("lang_pred")
    return out.select(*(col(c) for c in docs.columns if c != "lang_pred"), pred)


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, margin, rejected; learnt
    from the labelled rows that are not held out."""
    need(docs, doc_id, text, lang)
    model = learnt(docs.where(~held_out(col(doc_id))), doc_id, text, lang, **options)
    out = identified(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))
