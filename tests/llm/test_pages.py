"""Layout-aware text of pages: written-out expectations and whole texts."""

from __future__ import annotations

import random

import pytest

from heatgrid.llm.pages import extract, op10_html_layout, visible_text

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b <b>bold</b>,\n  c</div>d": "a\nb bold, c\nd",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<h1>T</h1>x<hr>y": "T\n\nx\n\ny",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=9><li>a<p>more</p><li>b</ol>": "9. a\n   more\n10. b",
    "<ul><li><ul><li>in</ul></ul>": "- - in",
    "<ul><li></li><li>x</li></ul>": "- x",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<table><caption>C</caption><tr><th>Name<th>N<tr><td>apple<td>1<tr><td colspan=2>wide cell here<tr><td>x<td>22</table>": "C\nName   N\napple  1\nwide cell here\nx      22",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>": "a  b\n   c  d",
    "<table><tr><td rowspan=3>long<td>b<td rowspan=2>x<tr><td>c<tr><td>d<td>e</table>": "long  b  x\n      c\n      d  e",
    "<table><tr><td rowspan=2 colspan=2>ab<td>b<tr><td>c<tr><td>d<td>e<td>f</table>": "ab    b\n      c\nd  e  f",
    "<table><tr><td rowspan=0>a<td rowspan=x>b<tr><td>c</table>": "a  b\nc",
    "<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>": "日本  x\nabcd  y",
    "<table><tr><td><p>a</p><p>b</p><td><table><tr><td>i<td>j</table></table>after": "a b  i j\n\nafter",
    "<pre>  x\n    <b>y</b> z\n</pre>w": "  x\n    y z\n\nw",
    "<head><title>t</title><style>p{}</style><p>body starts": "body starts",
    "<script>var a='<p>no</p>'</script>yes<!-- no --><template>no</template>": "yes",
    "a<span hidden>no</span><div style='color:red; display : none'>no</div>b": "ab",
    "<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "</p>x</div><b>y": "xy",
    "<select><option>a<option>b</select>": "a\nb",
    "a&nbsp; b c": "a  b c",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


def test_broken_deep_and_long_pages():
    rnd = random.Random(6)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<div hidden>", "</div>", "w ", "<", "&", "<!--", "-->", "<b", ">", "</"]
    for _ in range(300):
        visible_text("".join(rnd.choice(parts) for _ in range(60)))
    assert visible_text("<div>" * 20000 + "x") == "x"
    assert visible_text("<ul><li>" * 3000 + "x").endswith("- x")
    assert visible_text("<table><tr><td>" * 500 + "x") == "x"
    words = [f"w{i}" for i in range(100000)]
    assert visible_text("<p>" + " ".join(f"<i>{w}</i>" for w in words)).split() == words


def test_rows(spark):
    rows = [(1, "u", "<p>a<p>b c", "x"), (2, None, None, None), (3, "", "", ""), (None, "", "<b>n", ""), (1, "u", "<p>a<p>b c", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(str, map(tuple, extract(df).collect())))
    assert got == sorted(map(str, [(1, "a\n\nb c", 2, 3), (2, None, 0, 0), (3, "", 0, 0), (None, "n", 1, 1), (1, "a\n\nb c", 2, 3)]))
    assert extract(df.limit(0)).count() == 0


def test_query_keeps_every_page(spark, tmp_path):
    spark.createDataFrame([(i, f"<ul><li>p{i}</ul>") for i in range(50)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in op10_html_layout(spark, str(tmp_path)).collect()} == {i: f"- p{i}" for i in range(50)}
