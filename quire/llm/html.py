"""HTML extraction by layout: a tree with implied tags and visibility rules is rendered
as a browser's text would stand, with block spacing, lists and aligned table cells.

``extract`` is a narrow ``mapInArrow`` over the pages; the renderer below is the helper of
one page and works with its own stack, so nesting depth is no matter.

Rules. Not visible: head, script, style, template, noscript, the form controls' values,
elements with ``hidden`` or a style of display:none or visibility:hidden, closed
dialogs, the body of closed details, descriptions and definitions of drawings. Text of svg and
math and the options of a select are visible. Paragraphs, headings, lists, tables, quotes and preformatted text stand between
blank lines, other blocks on lines of their own. White space collapses except in pre.
List items have "- " or their number, nested ones are indented. A table row is one line
(or as many as its tallest cell), cells padded to their column up to MAX_PAD; a cell with rowspan keeps
its columns free in the rows below (unless a table's spans would fill over MAX_FILL places: then
its rows stand without them, with all their text). The time is linear in the page.

Defined results: null html gives null text, empty html empty text; unclosed tags,
comments and quotes end with the page; repeated rows are rendered each.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, col, need
from quire.llm.words import portions

MAX_PAD = 60
MAX_SPAN = 100
MAX_FILL = 1_000_000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+'|["'])*+)>|<[!?/][^>]*+>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANK = re.compile(r"[ \t\r\n\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas textarea desc metadata defs annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main nav section summary tr tbody thead tfoot td th menu optgroup option".split())
#: An opening tag on the left ends these open elements, up to the nearest of the stops.
CELL_OR_TABLE = ("table", "td", "th")
LIST, TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
ENDS = {
    "li": (frozenset(("li",)), LIST),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), TABLE),
    "td": (frozenset(("td", "th")), TABLE | {"tr"}),
    "th": (frozenset(("td", "th")), TABLE | {"tr"}),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
for _t in ("thead", "tbody", "tfoot"):
    ENDS[_t] = (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), TABLE)


class Node:
    __slots__ = ("tag", "children", "seen", "attrs")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.seen = tag not in UNSEEN and "hidden" not in attrs and not (tag == "dialog" and "open" not in attrs) and not ("style" in attrs and UNSEEN_STYLE.search(attrs["style"]))


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def tree(text: str) -> Node:
    """The page's elements; missing end tags, table rows and lists' items are implied."""
    root = Node("html", {})
    stack, at = [root], 0
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag

    def open_(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            places[tag].append(len(stack))
            stack.append(node)

    def cut(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()

    def nearest(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def end(tags: frozenset, stops: frozenset) -> None:
        """Close everything from the outermost open element of ``tags`` above a stop."""
        if any(places.get(t) for t in tags):
            above = nearest(stops)
            found = [places[t][i] for t in tags if places.get(t) and (i := bisect_right(places[t], above)) < len(places[t])]
            if found:
                cut(min(found))

    last = text.rfind(">")
    while at < len(text):
        m = TOKEN.match(text, at) if at <= last or text[at] != "<" or not text[at + 1 : at + 2].isalpha() else None
        if m is None or m[0] == "<" and text[at + 1 : at + 2].isalpha():  # a tag that never ends
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(entities.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and nearest(("p",)) <= nearest(CELL_OR_TABLE):
                open_("p", {})
            if tag == "br":
                open_("br", {})
            mine = nearest((tag,))
            if mine and (mine >= nearest(CELL_OR_TABLE) or tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")):
                cut(mine)
            continue
        if len(stack) > 1 and stack[1].tag == "head" and tag in BLOCK:
            cut(1)
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            end(frozenset(("p",)), frozenset(("td", "th", "button", "table", "div", "li", "article", "section", "blockquote")))
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        open_(tag, attributes(m[3]))
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(text, at)
            if tag not in UNSEEN:
                stack[-1].children.append(text[at : close.start() if close else len(text)])
            at = close.end() if close else len(text)
            cut(len(stack) - 1)
    return root


class Page:
    """Lines under construction: collapsed inline text, and gaps between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        self.now.append(BLANK.sub(" ", s))

    def line(self, empty: bool = False) -> None:
        """End the current line; one without text counts only if ``empty``."""
        s = re.sub(" {2,}", " ", "".join(self.now)).strip(" ")
        self.now = []
        if s or empty:
            self.put(s)

    def put(self, s: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        pad = "".join(self.indent)
        if self.mark:
            pad, self.mark = pad[: -len(self.mark)] + self.mark, ""
        self.lines.append((pad + s).rstrip())

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap |= int(spaced)

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def rendered(root: Node, depth: int = 0) -> str:
    page = Page()
    work: list = [(root, None)]
    while work:
        node, leave = work.pop()
        if isinstance(node, str):
            page.text(node)
            continue
        if leave is not None:
            leave()
            continue
        if not node.seen:
            continue
        tag = node.tag
        if tag == "br":
            page.line(empty=True)
            continue
        if tag == "table" and depth < 8:
            page.block(True)
            for x in table_lines(node, depth):
                page.put(x)
            page.gap = 1
            continue
        if tag == "pre":
            page.block(True)
            for x in preformatted(node).split("\n"):
                page.put(x)
            page.gap = 1
            continue
        if tag in ("td", "th"):
            page.now.append(" ")
        if tag in BLOCK and tag not in ("td", "th"):
            nested = tag in LIST and len(page.indent) > 0
            page.block(tag in SPACED and not nested)
            after = [lambda s=tag in SPACED and not nested: page.block(s)]
            if tag == "li":
                mark = "- "
                if node.attrs.get("_n"):
                    mark = node.attrs["_n"] + ". "
                page.indent.append(" " * len(mark))
                page.mark = mark
                after.append(lambda: (page.line(), page.indent.pop(), setattr(page, "mark", "")))
            elif tag in ("blockquote", "dd"):
                page.indent.append("  ")
                after.append(lambda: (page.line(), page.indent.pop()))
            if tag == "ol":
                start = node.attrs.get("start", "")
                for n, x in enumerate([c for c in node.children if isinstance(c, Node) and c.tag == "li"], int(start) if start.isdigit() and len(start) < 9 else 1):
                    x.attrs["_n"] = str(n)
            for f in after:
                work.append((node, f))
        shut = tag == "details" and "open" not in node.attrs
        for child in reversed(node.children):
            if not shut or isinstance(child, Node) and child.tag == "summary":
                work.append((child, None))
    return page.done()


def preformatted(node: Node) -> str:
    """Preformatted text, as it stands."""
    out, work = [], list(reversed(node.children))
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.seen:
            if x.tag == "br":
                out.append("\n")
            work.extend(reversed(x.children))
    return "".join(out).replace("\r\n", "\n").strip("\n")


def table_lines(table: Node, depth: int) -> list[str]:
    """A table's rows as lines, cells padded to their columns."""
    rows, captions, work = [], [], list(reversed(table.children))
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append(x.strip())
        elif x.seen and x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and c.seen and c.tag in ("td", "th")])
            captions += [rendered(_as_block(c), depth + 1) if isinstance(c, Node) else c.strip() for c in x.children if not (isinstance(c, Node) and c.tag in ("td", "th"))]
        elif x.seen and x.tag in ("tbody", "thead", "tfoot"):
            work.extend(reversed(x.children))
        elif x.seen:
            captions.append(rendered(_as_block(x), depth + 1))
    cells = [[(rendered(_as_block(c), depth + 1).split("\n"), _span(c), _span(c, "rowspan", len(rows))) for c in row] for row in rows]
    placed = _placed(cells)
    widths: dict[int, int] = {}
    for row in placed:
        for at, lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(MAX_PAD, max(map(len, lines))))
    out = [line for c in captions if c for line in c.split("\n")]
    for own, row in zip(cells, placed, strict=True):
        for n in range(max((len(x[0]) for x in own), default=0)):
            parts = []
            for at, lines, span in row:
                width = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)
                parts.append((lines[n] if n < len(lines) else "").ljust(width))
            out.append(" | ".join(parts).rstrip())
    return out


def _placed(cells: list) -> list[list[tuple[int, list[str], int]]]:
    """Every row's cells as (column, lines, span); places that a cell above still covers are empty ones."""
    spans = sum(min(down, len(cells) - i) - 1 for i, row in enumerate(cells) for _, _, down in row)
    spans = spans if spans <= MAX_FILL else 0
    out: list = []
    covered: dict[int, tuple[int, int]] = {}  # column: (rows still covered, span)
    for row in cells:
        line, at, left = [], 0, dict(covered)
        for lines, span, down in row:
            while at in left:
                line.append((at, [""], left[at][1]))
                at += left.pop(at)[1]
            line.append((at, lines, span))
            if spans and down > 1:
                covered[at] = (down, span)
            at += span
        line += [(c, [""], s) for c, (_, s) in sorted(left.items()) if c >= at]
        covered = {c: (n - 1, s) for c, (n, s) in covered.items() if n > 1}
        out.append(line)
    return out


def _as_block(node: Node) -> Node:
    copy = Node("div", {})
    copy.children = node.children if node.tag in ("td", "th", "caption") else [node]
    return copy


def _span(cell: Node, name: str = "colspan", most: int = MAX_SPAN) -> int:
    """How many columns or rows a cell covers; a rowspan of 0 goes to the end."""
    s = cell.attrs.get(name, "1")
    if not (s.isascii() and s.isdigit() and len(s) < 6):
        return 1
    return max(1, most) if name == "rowspan" and int(s) == 0 else min(most, max(1, int(s)))


def page_text(html: str | None) -> str | None:
    return None if html is None else rendered(tree(html.replace("\x00", "")))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the rendered text in the column ``text`` (replacing one so named)."""
    need(pages, html)
    kept = [c for c in pages.columns if c != text]
    given = pages.select(*map(col, pages.columns if html == text else kept))
    schema = given.select(*map(col, kept)).withColumn(text, F.lit("").cast("string")).schema
    schema[text].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, html):
                made = pa.array([page_text(x) for x in part.column(part.schema.get_field_index(html)).to_pylist()], pa.string())
                rest = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != text]
                yield pa.RecordBatch.from_arrays([*rest, made], names=schema.names)

    return arrow_map(given, run, schema)
