"""File sources (S1, S2, S5): listing, ordered validation, DOCX blocks.

``scan_sources`` lists files with the ``binaryFile`` source without reading
their bytes (the content column is pruned). ``read_docx`` parses DOCX
packages inside ``mapInPandas`` with the standard library (zip + XML), one
file per row, so parsing is spread over the cluster.
"""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import clean_text, strip_text

# Fixed values
SUPPORTED_EXTENSIONS = (".docx", ".pdf")
OCR_HINT = "If this is a scanned document it would need OCR, which is not supported."
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NO_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"  # characters that XML 1.0 has no place for
_NO_XML = re.compile(NO_XML + "|[\ufffe\uffff]")


# S1
def scan_sources(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "modificationTime")


def base_name(path) -> Column:
    return F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"([^/]*)$", 1)


def suffix(path) -> Column:
    """Lower-cased extension of the base name ('' when there is none)."""
    name = base_name(path)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


# S2
def validate_sources(df: DataFrame, path: str = "path", exists: str = "exists", text: str = "text", n_chunks: str | None = None, strategy: str = "fixed") -> DataFrame:
    """Ordered checks, first failure wins: missing file, unsupported suffix,
    no text after cleaning, and - where a column of chunk counts is named - no chunks
    by ``strategy``. Adds ``status``, ``error_class``, ``error_message``."""
    p = F.col(path)
    sfx = suffix(p)
    cleaned = clean_text(F.col(text))
    shown = F.when(sfx == "", F.lit("(none)")).otherwise(sfx)
    supported = ", ".join(sorted(SUPPORTED_EXTENSIONS))
    cls = (
        F.when(~F.coalesce(F.col(exists), F.lit(False)), "FileNotFoundError")
        .when(~sfx.isin(*SUPPORTED_EXTENSIONS), "UnsupportedFileTypeError")
        .when(cleaned == "", "NoTextExtractedError")
        .when(F.col(n_chunks) == 0 if n_chunks else F.lit(False), "NoChunksError")
    )
    msg = (
        F.when(cls == "FileNotFoundError", F.concat(F.lit("File not found: "), p))
        .when(cls == "UnsupportedFileTypeError",
              F.concat(F.lit("Unsupported file type '"), shown, F.lit(f"'. Supported types: {supported}.")))
        .when(cls == "NoTextExtractedError",
              F.concat(F.lit("No extractable text found in "), base_name(p), F.lit(". " + OCR_HINT)))
        .when(cls == "NoChunksError", F.concat(F.lit(f"The '{strategy}' strategy produced no chunks from "), base_name(p), F.lit(".")))
    )
    return df.withColumn("error_class", cls).withColumn("error_message", msg).withColumn(
        "status", F.when(F.col("error_class").isNull(), "ok").otherwise("quarantined")
    )


# S5
def docx_blocks(data: bytes) -> list[tuple[int, str, str | None, list[str] | None]]:
    """``(block_no, kind, text, cells)``: every paragraph, then every table row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    out = []
    n = 0
    if body is None:
        return out
    for p in (el for el in body if el.tag == f"{_W}p"):  # top-level paragraphs only
        out.append((n, "paragraph", "".join(t.text or "" for t in p.iter(f"{_W}t")), None))
        n += 1
    for tbl in (el for el in body if el.tag == f"{_W}tbl"):
        for tr in (el for el in tbl if el.tag == f"{_W}tr"):
            cells = [
                "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in tc if p.tag == f"{_W}p")
                for tc in tr if tc.tag == f"{_W}tc"
            ]
            out.append((n, "table_row", None, cells))
            n += 1
    return out


def docx_package(paragraphs: list[str], rows: list[list[str]]) -> bytes:
    """A DOCX file of paragraphs and one table; characters that XML has no place for are left out."""
    text = lambda t: "<w:p><w:r><w:t xml:space=\"preserve\">" + escape(_NO_XML.sub("", t)) + "</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{text(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = "".join(map(text, paragraphs)) + (f"<w:tbl>{table}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(docs: DataFrame, path: Column, paragraphs: Column, rows: Column) -> DataFrame:
    """(path, content) of one DOCX file a row, in the shape of ``binaryFile``."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [docx_package([x or "" for x in p], [[c or "" for c in r] for r in t]) for p, t in zip(pdf["paragraphs"], pdf["rows"])]
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    return docs.select(path.alias("path"), paragraphs.alias("paragraphs"), rows.alias("rows")).mapInPandas(pack, "path string, content binary")


def read_docx(binary: DataFrame) -> DataFrame:
    """``binaryFile`` rows -> blocks ``(path, block_no, kind, text, cells,
    error)``; an unreadable package yields one ``NoTextExtractedError`` row."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for b in docx_blocks(bytes(content)):
                        rows.append((path, *b, None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError) as exc:
                    name = path.rsplit("/", 1)[-1]
                    rows.append((path, -1, "error", None, None, f"Could not parse DOCX {name}: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "block_no", "kind", "text", "cells", "error"])

    schema = "path string, block_no int, kind string, text string, cells array<string>, error string"
    return binary.select("path", "content").mapInPandas(parse, schema)


def strip_cells(cells) -> Column:
    """Table row text: cells stripped, empty cells dropped, joined by ' | '."""
    kept = F.filter(F.transform(cells if isinstance(cells, Column) else F.col(cells), strip_text), lambda c: c != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))
