"""Text cleaning and structure as native Column expressions.

Every function takes and returns a Column and compiles to built-in
``regexp_replace`` / array higher-order functions, so cleaning stays inside the
JVM and fuses into one projection.

Regex dialect: Java's ``\\s`` and ``\\w`` are ASCII-only while the behaviour we
reproduce uses Unicode classes, so the classes below are spelled out. They are
written in a syntax that Java and RE2 (the DuckDB oracle) both accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Unicode whitespace as Python's str.isspace() defines it:
# TAB LF VT FF CR, U+001C-U+001F, SPACE, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS = (
    r"[\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NON_WS = WS.replace("[", "[^", 1)
# The same set as literal characters, for btrim.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# A "word" character: letters, numbers and underscore (Unicode).
WORD = r"[\p{L}\p{N}_]"
# Control characters removed by cleaning (TAB, LF and CR are kept).
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# Characters that end a line which is therefore not a heading.
HEADING_PUNCT = (".", ",", ";", ":", "!", "?")
# Reflow: only lines longer than this count towards the column width,
# and a line shorter than WIDTH_FACTOR x median closes its paragraph.
BODY_MIN_LEN = 20
WIDTH_FACTOR = 0.75
HEADING_MAX_LEN = 60
NUMBERED_HEADING = r"^\p{Nd}+(\.\p{Nd}+)*\.?" + WS + "+" + NON_WS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _where_found(col, marks: tuple[str, ...], change) -> Column:
    """``change`` of the texts that hold one of ``marks``; the others stay, after one search of their bytes. The
    lambda's variable stands for the text, so the steps before it are written, and run, once."""

    def one(text):
        found = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(text, F.lit(mark))
        return F.when(found, change(text)).otherwise(text)

    return F.get(F.transform(F.array(_c(col)), one), F.lit(0))


# T1
def null_to_empty(col) -> Column:
    return F.coalesce(_c(col), F.lit(""))


# T2
def normalize_newlines(col) -> Column:
    """CRLF, then lone CR, to LF (plain replaces: no regex pass needed)."""
    return F.replace(F.replace(_c(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


# T3
def dehyphenate(col) -> Column:
    """Join a word broken by a hyphen directly followed by a newline."""
    return _where_found(col, ("-\n",), lambda t: F.regexp_replace(t, f"({WORD})-\n({WORD})", "$1$2"))


# T4
CONTROL_CHARS = "".join(chr(c) for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20)])


def strip_control_chars(col) -> Column:
    """Delete the control characters (``translate`` with no replacement)."""
    deleted = lambda t: F.when(t.rlike(CONTROL), F.translate(t, CONTROL_CHARS, "")).otherwise(t)
    return F.get(F.transform(F.array(_c(col)), deleted), F.lit(0))


# T5
def collapse_spaces(col) -> Column:
    return _where_found(col, ("  ", "\t"), lambda t: F.regexp_replace(t, "[ \t]{2,}|\t", " "))


# T6
def trim_around_newlines(col) -> Column:
    return _where_found(col, (" \n", "\n "), lambda t: F.regexp_replace(t, " *\n *", "\n"))


# T7
def collapse_blank_lines(col) -> Column:
    return _where_found(col, ("\n\n\n",), lambda t: F.regexp_replace(t, "\n{3,}", "\n\n"))


# T8
def strip_text(col) -> Column:
    """Unicode strip of both ends (Spark's trim removes only U+0020): ``btrim``
    with the explicit whitespace set, linear in the trimmed length."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


# T9
def clean_text(col) -> Column:
    """T1..T8 in order; Catalyst fuses them into a single projection."""
    t = null_to_empty(col)
    t = normalize_newlines(t)
    t = dehyphenate(t)
    t = strip_control_chars(t)
    t = collapse_spaces(t)
    t = trim_around_newlines(t)
    t = collapse_blank_lines(t)
    return strip_text(t)


def split_lines(col) -> Column:
    """Lines of a text, each Unicode-stripped (empty strings kept)."""
    return F.transform(F.split(_c(col), "\n", -1), strip_text)


# T10
def column_width(lines) -> Column:
    """Median length of lines longer than 20 chars (null if there are none).

    Even counts average the two middle values, like ``statistics.median``.
    """
    lens = F.array_sort(F.filter(F.transform(_c(lines), F.length), lambda n: n > BODY_MIN_LEN))
    n = F.size(lens)
    lo = F.try_element_at(lens, F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)))
    hi = F.try_element_at(lens, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lo.cast("double") + hi.cast("double")) / 2)


def ragged_threshold(lines) -> Column:
    return column_width(lines) * F.lit(WIDTH_FACTOR)


# T11
def is_heading(line) -> Column:
    """Numbered heading, or a short line without closing punctuation."""
    line = _c(line)
    numbered = line.rlike(NUMBERED_HEADING)
    short = (F.length(line) < HEADING_MAX_LEN) & ~F.right(line, F.lit(1)).isin(*HEADING_PUNCT)
    return numbered | short


# T12
def reflow_paragraphs(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Rebuild paragraphs from hard-wrapped lines, row-locally (no shuffle).

    Every non-empty line is emitted in order; it joins the previous line with a
    space when that previous line is a non-empty, non-heading line at least as
    long as the ragged threshold and the line itself is not a heading; in every
    other case a paragraph break (blank line) separates them. Text without a
    body line (> 20 chars) is returned unchanged.

    This is the set form of the sequential line walk. The line array, heading
    flags and threshold are materialised as columns first so the per-line
    lambda only indexes them (O(lines) per document, not O(lines^2)).
    """
    out = out or col
    tmp_l, tmp_h, tmp_t, tmp_f = "__rf_lines", "__rf_heads", "__rf_thr", "__rf_first"
    staged = df.withColumn(tmp_l, split_lines(col))
    staged = staged.withColumn(tmp_h, F.transform(F.col(tmp_l), is_heading)).withColumn(
        tmp_t, ragged_threshold(F.col(tmp_l))
    ).withColumn(tmp_f, F.array_position(F.transform(F.col(tmp_l), lambda l: l != ""), True))
    lines, heads, thr, first = F.col(tmp_l), F.col(tmp_h), F.col(tmp_t), F.col(tmp_f)

    def emit(line, i):
        prev = F.try_element_at(lines, F.greatest(i, F.lit(1)))  # lines[i-1] when i >= 1
        prev_head = F.try_element_at(heads, F.greatest(i, F.lit(1)))
        own_head = F.try_element_at(heads, i + 1)
        joins = (prev != "") & ~prev_head & (F.length(prev) >= thr) & ~own_head
        sep = F.when(i + 1 == first, F.lit("")).when(joins, F.lit(" ")).otherwise(F.lit("\n\n"))
        return F.when(line != "", F.concat(sep, line))

    rebuilt = F.array_join(F.transform(lines, emit), "")
    return staged.withColumn(out, F.when(thr.isNull(), F.col(col)).otherwise(rebuilt)).drop(
        tmp_l, tmp_h, tmp_t, tmp_f
    )
