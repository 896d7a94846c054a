"""The main text operator against pages whose text is known, and a plain reading of the given pages."""

import re
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from tradeloom.llm.main_text import main_text, main_texts, op13_main_text

SF_DIR = "/root/testdata/sf0.001"
LONG = "The committee met on Tuesday to weigh the plan, and by the end of the evening most of its members had spoken for it. " * 3
MORE = "Opponents pointed at the cost of the bridge, at the noise of the road, and at two earlier plans that came to nothing. " * 3
LINKS = "".join(f'<li><a href="/{w}">{w} and more</a></li>' for w in ("Home", "News", "Sport", "Trade", "Letters", "Archive"))


def folded(*texts):
    return " ".join(" ".join(t.split()) for t in texts)


PAGES = {
    "article": (
        f"<body><header><h1>Daily Site</h1></header><nav><ul>{LINKS}</ul></nav><article><h1>A plan</h1><p>{LONG}</p><h2>Cost</h2><p>{MORE}</p><p>Short end.</p>"
        f"<aside>Did you know? {LONG}</aside><footer>Filed under plans</footer></article><section id='comments'><article class='comment'><p>{MORE}</p></article></section><footer>&copy; Site</footer></body>",
        ("A plan", LONG, "Cost", MORE, "Short end."),
    ),
    "article header": (
        f"<body><article><header class='entry-header'><h1>A plan</h1><div>By someone</div></header><p>{LONG}</p></article></body>",
        ("A plan", LONG),
    ),
    "plain divs": (
        f"<body><div class='site-header'>My site of plans</div><div id='nav-bar'><ul>{LINKS}</ul></div><div id='wrap'><div class='content'><h1>A plan</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div>"
        f"<div class='sidebar-right'><p>{MORE}</p></div></div><div class='cookie-notice'>We use cookies. {MORE}</div><div class='footer-text'>All rights</div></body>",
        ("A plan", LONG, "Short.", MORE),
    ),
    "nameless divs": (
        f"<body><div><ul>{LINKS}</ul></div><div><div><h1>A plan</h1><p>{LONG}</p><p>{MORE}</p><p>Short end.</p></div></div><div><ul>{LINKS}</ul></div></body>",
        ("A plan", LONG, MORE, "Short end."),
    ),
    "sections": (
        f"<body><div><ul>{LINKS}</ul></div><div><section><h2>One</h2><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></div></body>",
        ("One", LONG, MORE, LONG, "Two", MORE),
    ),
    "main and form": (
        f"<body><form action='/'><main><h1>A plan</h1><p>{LONG} <a href='/x'>as said</a> before.</p><form><input name=q><label>Search</label></form><div class='comments-area'><p>{MORE}</p></div></main></form></body>",
        ("A plan", LONG + " as said before."),
    ),
    "body only": (f"<p>{LONG}<p>{MORE}<ul><li>one<li>two</ul>", (LONG, MORE, "one", "two")),
    "inline, hidden, comments": (
        f"<body class='has-sidebar'><article><p>un<b>brok</b>en &amp; &lt;p&gt; caf&eacute;&nbsp;noir<br>x</p><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p><span class='ad'>buy</span><script>'</p>'</script>"
        f"<p>{LONG}</p></article>",
        ("unbroken & <p> café noir x", LONG),
    ),
    "cut off": (f"<body><nav><ul>{LINKS}</ul></nav><article><h1>A plan</h1><p>{LONG}</p><p>end &am", ("A plan", LONG, "end &am")),
    "cut in a tag": (f"<body><article><p>{LONG}</p><p>end<a href='", (LONG, "end")),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html) == folded(*want)


def test_nothing_to_find():
    for html in (None, "", " \n", "<html><head><title>x</title></head><body></body></html>", f"<nav><ul>{LINKS}</ul></nav>", "<!--", "<script>x"):
        assert main_text(html) == ""
    assert main_text("no markup  at all") == "no markup at all"


def test_long_and_deep_pages():
    deep = "<div>" * 20000 + "<p>" + LONG
    assert main_text(deep) == folded(LONG)
    paragraphs = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert main_text(f"<article>{paragraphs}</article>") == folded(*(f"{LONG} {i}" for i in range(5000)))
    for unclosed in ("<a b='", "<b>", "<ul><li>", "<p><div>", "<i>x</b>", "<b><i>x</i></u>"):
        assert folded(LONG) in main_text(f"<p>{unclosed * 20000}</p><p>{LONG}")


def test_given_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF_DIR}/pages.parquet'").fetchall()
    want = {}
    for page, html in rows:
        article = html.split("<article>")[1].split("</article>")[0]
        want[page] = folded(*(t for t in (unescape(b) for b in re.split(r"</?(?:p|h1|br|b)>", article)) if t.strip()))
    got = {r.page_id: (r.text, r.n_chars) for r in op13_main_text(spark, SF_DIR).collect()}
    assert got == {page: (text, len(text)) for page, text in want.items()}


def test_rows(spark):
    html = PAGES["plain divs"][0]
    rows = [(1, "u", html, "a", 5), (1, "u", html, "a", 5), (None, None, None, None, None), (2, "v", "", "b", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _id int")
    got = main_texts(pages)
    assert got.columns == ["page_id", "url", "_id", "text", "n_chars"]
    text = folded(*PAGES["plain divs"][1])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", 5, text, len(text))] * 2 + [(None, None, None, "", 0), (2, "v", 6, "", 0)], key=str)
    assert main_texts(pages.where(F.lit(False))).count() == 0
