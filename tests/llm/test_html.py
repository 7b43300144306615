"""Rendering of pages: implied tags, visibility, spacing, lists, tables."""

import re
import time

import pytest

from oddrows.llm import html_text, queries
from oddrows.llm.html_text import render


def text(html):
    return render(html)[1]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("a <b>b</b>\n\t<i> c</i>", "a b c"),
        ("<h1>H</h1><p>x<br>y<br><br>z", "H\n\nx\ny\n\nz"),
        ("<ul><li>a<li>b<ol start=4><li>c<li value=9>d<li>e</ol></ul>", "- a\n- b\n  4. c\n  9. d\n  10. e"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("<table><tr><td>a<td>b<tr><td>long<td>c</table>", "a     b\nlong  c"),
        ("<table><tr><th>n<th colspan=2>wide<tr><td rowspan=2>x<td>1<td>2<tr><td>3<td>4</table>", "n  wide\nx  1  2\n   3  4"),
        ("<table><tr><td>漢<td>b<tr><td>abc<td>c</table>", "漢   b\nabc  c"),
        ("<table><caption>C</caption><td>1<tfoot><tr><td>f</tfoot><tbody><tr><td>2</table>", "C\n1\n2\nf"),
        ("<table><table><tr><td>a</table>b", "a\n\nb"),
        ("<td>x<td>y", "x\ny"),
        ("<pre>\n a  b\n\tc</pre>", " a  b\n\tc"),
        ("<p hidden>a</p><p style='color:red; DISPLAY : none'>b</p><script>c</script><template>d</template><p style='display:nonexistent'>e", "e"),
        ("<input type=hidden value=x><input value=y><select><option>1<option selected>2</select>", "y 2"),
        ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
        ("<title>T</title>a &amp; b &lt;i&gt; &copy;&nbsp;c", "a & b <i> © c"),
        ("<!-- <p>x --> a <!-- never ends", "a"),
        ("a <p title='1 > 0' data-x=\"</p>\">b", "a\n\nb"),
        ("<script>if (a < b) '</p>'</script>x</SCRIPT >y", "xy"),
        ("1 < 2 and <3 & <a href=\"x", "1 < 2 and <3 &"),
        ("<b>a<p>b</b>c", "a\n\nbc"),
        ("<a href=1>x<a href=2>y</a></p>z", "xy\nz"),
        ("<blockquote>a<blockquote>b</blockquote></blockquote>", "    a\n\n        b"),
        ("<map><p>links</map> rest of page", "links rest of page"),
        ("a<object><p>alt</object>rest", "arest"),
        ("<button><p>go</button>rest", "go\n\nrest"),
        ("<select multiple><option>a<option>b<option hidden>c</select>d", "a\nb\nd"),
        ("<select size=3><option>a<option selected>b</select>", "a\nb"),
        ("<select size=1><option>a<option selected>b</select>", "b"),
        ("", ""),
        (None, ""),
    ],
)
def test_render(html, want):
    if html and html.startswith("<title"):
        assert render(html)[0] == "T"
    assert text(html) == want


def test_deep_elements_end_themselves_and_hide():
    deep = "<div>" * 300
    assert text(deep + "<div hidden>no<div>no</div></div>yes") == "yes"
    assert text("<section>a" + deep + "<section>b</section>c" + "</div>" * 300 + "</section>d").split() == ["a", "b", "c", "d"]


def test_words_of_whole_pages(spark):
    """The words of every page, in order, as a plain parser without layout finds them."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.unseen = [], []

        def handle_starttag(self, tag, attrs):
            given = dict(attrs)
            gone = tag in html_text.UNSEEN or "hidden" in given or html_text.HIDING.search(given.get("style") or "")
            if tag not in html_text.VOID and (gone or self.unseen):
                self.unseen.append(tag)

        def handle_endtag(self, tag):
            if self.unseen and tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.unseen:
                self.found += re.findall(r"\w+", data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(pages) > 100
    for r in pages:
        plain = Words()
        plain.feed(r["html"] or "")
        shown = re.sub(r"(?m)^ *\d+\. ", " ", render(r["html"])[1])
        assert re.findall(r"\w+", shown) == plain.found, r["page_id"]


def test_hostile_pages_take_linear_time():
    start = time.time()
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text("<table><tr><td>" * 300 + "deep").strip() == "deep"
    text('<a "' * 5_000)
    text("<ul><li>" * 3_000 + "x")
    assert text("<p " + "a='" * 20_000) == ""
    wide = "<table>" + "<tr><td>" + "w" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 2_000 + "</table>"
    assert len(text(wide)) < 400_000
    assert time.time() - start < 60


def test_frame(spark):
    rows = [(1, "u", "<p>a<p>b", "x"), (1, "u", "<p>a<p>b", "x"), (None, None, None, None), (2, "u", "", "y"), (3, "u", "<p>" + "long word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, title string")
    out = sorted(((r["page_id"] or 0, r["title"], len(r["text"]), r["n_chars"]) for r in html_text.page_texts(df).collect()))
    assert out == [(0, "", 0, 0), (1, "", 4, 4), (1, "", 4, 4), (2, "", 0, 0), (3, "", 499_999, 499_999)]
    assert html_text.page_texts(df.limit(0)).collect() == []


def test_op8_whole_table(spark):
    want = {r["page_id"]: render(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: (r["title"], r["text"]) for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    for title, shown in got.values():
        assert title and "<p>" not in shown and "track(" not in shown and "margin:0" not in shown
