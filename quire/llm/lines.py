"""Line dedup by site-relative frequency, in DataFrame functions.

Pages are grouped by host; a line's ratio is the number of the host's pages that hold
it over the host's pages, and lines over the boilerplate ratio (in MIN_PAGES pages at
least) are dropped from the host's pages. Counting is one aggregation by (host, line
hash), combined before the shuffle, so a host or line with a third of all rows is a
few partial counts. A host's boilerplate is short by construction (each of its lines
fills over ``ratio`` of the pages, so there are fewer than mean lines a page / ratio): it
joins the pages as one array a host, and no page's lines are collected again.

Defined results: a null url, or one without a host, belongs to the host ""; null html
has no lines and gives null text; empty html gives empty text; repeated rows count as pages
of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, need, own, staged

RATIO = 0.2
MIN_PAGES = 3
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
UNSEEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<![a-z][^>]*>"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>"
TAG = r"</?[A-Za-z][^<>]*>"
#: The character references that are decoded, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def text_lines(text: Column) -> Column:
    """Lines of plain text, inner blanks collapsed, without empty ones."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.filter(lines, lambda x: x != "")


def html_lines(html: Column) -> Column:
    """The lines of a page: its text between block tags."""
    x = F.regexp_replace(html, UNSEEN, " ")
    x = F.regexp_replace(x, r"[ \t\r\n\f]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, BLOCKS, "\n"), TAG, "")
    for name, is_ in REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(is_))
    return text_lines(x)


def deduplicated_lines(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with host, n_lines, n_dropped and text (kept lines) in a struct column
    named "deduplicated" (replacing one of that name)."""
    row, h, l, bad = own("row"), own("host"), own("lines"), own("bad")
    work = staged(pages.select(F.struct(*map(col, pages.columns)).alias(row), F.coalesce(host, F.lit("")).alias(h), lines.alias(l)), "lines")
    totals = work.groupBy(h).agg(F.count(F.lit(1)).alias("pages"))
    seen = work.select(h, F.explode(F.array_distinct(F.transform(l, lambda x: F.xxhash64(x)))).alias("line")).groupBy(h, "line").agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= min_pages).join(totals, h).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    often = staged(often.groupBy(h).agg(F.sort_array(F.collect_list("line")).alias(bad)), "boilerplate")
    out = work.join(often, h, "left")
    kept = F.when(F.col(bad).isNull(), F.col(l)).otherwise(F.filter(l, lambda x: ~F.array_contains(bad, F.xxhash64(x))))
    got = F.struct(F.col(h).alias("host"), F.coalesce(F.size(l), F.lit(0)).alias("n_lines"), F.coalesce(F.size(l) - F.size(kept), F.lit(0)).alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
    got = F.when(F.col(l).isNull(), F.struct(F.col(h).alias("host"), F.lit(0).alias("n_lines"), F.lit(0).alias("n_dropped"), F.lit(None).cast("string").alias("text"))).otherwise(got)
    return out.select(*[F.col(row)[c].alias(c) for c in pages.columns if c != "deduplicated"], got.alias("deduplicated"))


def page_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """One row for each page: page_id, host, n_lines, n_dropped, text."""
    need(pages, page_id, url, html)
    some = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(html).cast("string").alias("html"))
    out = deduplicated_lines(some, host_of(F.col("url")), html_lines(F.col("html")), **options)
    return out.select("page_id", "deduplicated.*")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace(html, {quoted(UNSEEN)}, ' ', 'g')"
    x = rf"regexp_replace({x}, '[ \t\r\n\f]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {quoted(BLOCKS)}, chr(10), 'g'), {quoted(TAG)}, '', 'g')"
    for name, is_ in REFERENCES:
        x = f"replace({x}, {quoted(name)}, {quoted(is_)})"
    return rf"""
with l as (select page_id, regexp_extract(lower(coalesce(url, '')), {quoted(HOST)}, 1) host, html,
    list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r\f]+', ' ', 'g'))), lambda s: s <> '') ls from pages),
t as (select host, count(*) pages from l group by 1),
seen as (select host, line, count(*) n from (select host, unnest(list_distinct(ls)) line from l) group by 1, 2),
often as (select host, list(line) bad from seen join t using (host) where n >= {MIN_PAGES} and n > {RATIO} * pages group by 1)
select page_id, host, coalesce(len(ls), 0) n_lines, coalesce(len(list_filter(ls, lambda s: list_contains(coalesce(bad, []), s))), 0) n_dropped,
  case when html is not null then array_to_string(list_filter(ls, lambda s: not list_contains(coalesce(bad, []), s)), chr(10)) end as text
from l left join often using (host)
"""


LINES_SQL = _sql()
