"""Main text of pages: made-up layouts, odd markup, and all test pages against a plain reading."""

from __future__ import annotations

import html
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgemill.llm.html_text import extract, main_text

DATA = Path("/root/testdata/sf0.001")
LONG = "A sentence that goes on for a while, with a comma or two, so that it reads like prose and not like a label."

PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style></head><body class="home has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many cookies, and cookies. {LONG}</p></div>
<div id="page"><div class="layout-sidebar-right main">
<h1>Head&shy;ing &amp; more</h1><p>First {LONG}<br>next &#8220;line&#x201d;&nbsp;<b>bold <i>both</b></i><p>Second {LONG}
<ul><li>one, and<li>two {LONG}</ul><script>var x = "<p>no</p>";</script>
<div class="related"><a href="1">Read this, too</a></div><div><a href="2">Another</a> <a href="3">story</a></div>
<table><tr><td>cell one<td>cell two</table><blockquote>Quoted {LONG}</blockquote><div class="adBox">Buy</div>
<form><p>Your name, please. {LONG}</p></form></div>
<aside>{LONG}</aside><section id="comments"><div class="comment-body"><p>I think, as a reader, that {LONG}</p><p>Me too. {LONG} {LONG}</p></div></section></div>
<footer><p>&copy; us. {LONG}</p></footer></body></html>"""


def test_layout():
    assert main_text(PAGE).split("\n") == ["Head­ing & more", f"First {LONG} next “line” bold both", f"Second {LONG}", "one, and", f"two {LONG}", "cell one", "cell two", f"Quoted {LONG}"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>only</a></nav>", ""), ("plain text, no markup", "plain text, no markup"), ("<p>a < b & c &lt; d", "a < b & c < d"),
        ("<body><article><h1>x</h1><p>x</p></article><div>A much longer remark, with commas, many, many of them, outside of the article.</div>", "x\nx"),
        ("<div>one<p>two</p>three</div>", "one\ntwo\nthree"), ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"), ("<p title='a > b'>q</p>", "q"), ('<p title="open>q</p>', "q"),
        ("<p>&notit; &amp;lt; &#0; &#xD800; &unknown;</p>", "¬it; &lt; � � &unknown;"), ("<div><p>a\t\r\n\f b  c</p></div>", "a b c"),
        ("<article><header>By me</header><p>text</p><footer>tags</footer></article>", "text"), ("<script>never closed <p>x</p>", ""), ("<p hidden>no</p><p>yes</p>", "yes"),
        (f"<main><h1>Title</h1><div class=content>{f'<p>{LONG}</p>' * 40}</div></main>", "\n".join(["Title", *[LONG] * 40])),
        (f"<div>{f'<p>{LONG}</p>' * 3}</div><div><a href=1>{LONG}</a> <a href=2>{LONG}</a></div>", "\n".join([LONG] * 3)),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000) == "deep"
    words = " ".join(f"w{i}" for i in range(400_000))  # longer than a block of texts
    assert main_text(f"<article><p>{words}</p></article>") == words


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbadiv=\"' &;#x\n", max_size=60))
def test_any_text_is_read(page):
    assert not re.search(r"(^|\n)\s|\s(\n|$)|  |\n\n", main_text(page))


def test_rows(spark, table):
    rows = [(1, "u", "<p>a", "mine"), (1, "u", "<p>a", "mine"), (None, None, None, None), (2, "v", "", "")]
    got = extract(table(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(got.collect(), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract(table([], "page_id long, html string")).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_op13_against_a_plain_reading(spark):
    from ridgemill.llm.queries import op13_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op13_html_extraction(spark, str(DATA)).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        lines = [" ".join(html.unescape(part).split()) for part in re.split("(?:<[^>]*>)+", article)]
        assert r["text"] == "\n".join(filter(None, lines)) and r["n_chars"] == len(r["text"])
