"""Rendered text, case by case."""

import time

import pytest

from quire.llm import html as H

CASES = [
    ("<p>Hello <b>bold</b> &amp; x<p>Second<br>line", "Hello bold & x\n\nSecond\nline"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n  - in\n- three"),
    ("a<ol start=3><li>x<li>y</ol>b", "a\n\n3. x\n4. y\n\nb"),
    ("<table><tr><th>Name<th>N<tr><td>abc def<td>1<tr><td>x<td>22</table>", "Name    | N\nabc def | 1\nx       | 22"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>1<td>22<td>333</table>", "wide   | c\n1 | 22 | 333"),
    ("<table><td>a<p>b<td>c</table>", "a | c\n  |\nb |"),
    ("x<pre>  a\n   b</pre>y", "x\n\n  a\n   b\n\ny"),
    ("end<div hidden>no</div><div style='display: none'>no</div>tail", "endtail"),
    ("<head><title>T</title><style>p{}</style><script>'</p>'</script></head><body>B<textarea>no</textarea>", "B"),
    ("<script>var t='</p><b>';</script>seen<noscript>no</noscript><template>no</template>", "seen"),
    ("x<!-- <p>no --> y<!-- unclosed", "x y"),
    ("<div title=\"a>b\">q</div><p title='c>d'>r", "q\n\nr"),
    ("a\n  b\t c&nbsp;d &lt;e&gt; &copy;", "a b c d <e> ©"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<blockquote>q<blockquote>r</blockquote></blockquote>s", "  q\n\n    r\n\ns"),
    ("a < b and <3", "a < b and <3"),
    ("<div>1<div>2</div>3</div>", "1\n2\n3"),
    ("t<br><br>u</p>v", "t\n\nu\n\nv"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"),
    ("<table><tr><td>x<td rowspan=0>y<tr><td>1<td>2<tr><td>3</table>", "x | y\n1 |   | 2\n3 |"),
    ("<table><tr><td rowspan=3 colspan=2>ab<td>c<tr><td>d</table>", "ab  | c\n    | d"),
    ("<svg><title>no</title><desc>no</desc><text>drawn</text></svg> <math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "drawn x=2"),
    ("<select><option>one<option selected>two</select>", "one\ntwo"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<p>a<button>b<hr>c</button></p>d", "ab\n\nc\n\nd"),
    ("", ""),
    (" \n ", ""),
    ("<p>", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_page_text(html, text):
    assert H.page_text(html) == text


def test_deep_long_and_hostile_pages_end():
    assert H.page_text("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
    assert H.page_text("<table><tr><td>" * 3000 + "in").endswith("in")
    assert H.page_text("<a b='" * 20_000) == "" and H.page_text("<" * 50_000) == "<" * 50_000
    assert len(H.page_text("word " * 300_000)) == 1_499_999
    assert H.page_text("<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"


@pytest.mark.parametrize("page, text", [
    ("<p></p>" + "<b>" * 60_000 + "<hr>" * 60_000 + "x", "x"),
    ("<p><button>" + "<b>" * 60_000 + "<hr>" * 60_000 + "x", "x"),
    ("<table><tr>" + "<td rowspan=9999>a" * 3_000 + "<tr><td>b" * 3_000, None),
    ("<li>" * 100_000 + "</p>" * 50_000 + "x", None),
])
def test_hostile_pages_take_linear_time(page, text):
    start = time.perf_counter()
    out = H.page_text(page)
    assert time.perf_counter() - start < 4 and (out == text if text else out.count("b") + out.count("x") > 0)


def test_every_visible_word_is_kept(spark):
    from conftest import SF_SMALL  # tests/conftest.py

    import re

    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        raw = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r["html"])
        want = re.sub(r"<[^>]+>", " ", raw).replace("&copy;", "©").replace("&middot;", "·").replace("&amp;", "&").split()
        assert [w for w in H.page_text(r["html"]).split() if w != "-"] == want


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old", 5), (1, "<p>a", "old", 5), (2, None, None, None), (None, "", "t", 1)], "page_id long, html string, text string, `x.y` int")
    out = H.extract(pages)
    assert sorted(out.columns) == sorted(pages.columns)
    assert sorted(((r["page_id"] or 0), r["text"]) for r in out.where("text is not null").collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert out.count() == 4 and H.extract(pages.limit(0)).count() == 0
