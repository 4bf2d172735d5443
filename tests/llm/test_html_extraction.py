"""Main text of pages: written-out pages with a known article, the given pages, and anything at all."""

import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shiftframe.llm import html_extraction as he

SF = "/root/testdata/sf0.01"
LONG = "A long paragraph of the article that tells the whole story with many words and hardly any markup in it, as articles do."
MORE = "Another paragraph, of the same length more or less, goes on with the story and says what happened after that on the same day."
BODY = f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p>"
WANT = ["The title", LONG, "Short.", MORE]
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>"
PAGES = {
    "semantic": f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><header><h1>Site</h1></header>{NAV}<main><article>{BODY}</article></main><aside>Other texts of the site, which go on for a while here.</aside><footer>&copy; 2024</footer></body></html>",
    "classes": f"<body><div class='site-header'>Site</div><div id='main-nav'><a>One</a> <a>Two</a></div><div class='ad'>Buy this now, it is very cheap and very good for you and all.</div><div class='content has-sidebar'>{BODY}</div><div class='sidebar'><p>{MORE}</p></div><div id=footer>Imprint</div></body>",
    "no end tags": f"<body><div class=ad>An advert in few words.</div><article><h1>The title</h1><p><b>{LONG}<br><p>Short.<p>{MORE}</article><footer>x",
    "never closed": f"<nav><a>Menu</a></nav><article><h1>The title</h1><p>{LONG}<p>Short.<p>{MORE}",
    "comments inside": f"<article>{BODY}<section class='comments'><h2>Comments</h2><p>{LONG}</p><article><p>{MORE}</p></article></section></article>",
    "comments as articles": f"<article>{BODY}<article><p>{LONG}</p></article></article>",
    "comments beside": f"<main><article>{BODY}</article><div id='comments'><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p><p>{MORE}</p></div></main>",
    "notices and forms": f"<div class='cookie-notice'>{LONG}</div><article>{BODY}<form><p>Your name</p><input><button>Send</button></form><div class='newsletter-signup'>Read more every day</div></article>",
    "teasers": f"<main><article>{BODY}</article><article class='teaser'><h2>Another one</h2><p>{LONG[:60]}</p></article></main>",
    "unclosed menu": f"<body><nav><ul><li><a href=/>Home</a><li><a href=/b>Other</a></ul><article>{BODY}</article></body>",
    "form around all": f"<form id='aspnet'><div class='menu'>Menu</div><main>{BODY}</main></form>",
    "header within": f"<article><header><h1>The title</h1></header><p>{LONG}</p><p>Short.</p><p>{MORE}</p><footer>By somebody</footer></article>",
    "hidden": f"<article>{BODY}<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>no</span></article>",
    "plain": f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p>",
    "table": f"<table><tr><td class=menu><a>x</a></td><td>{BODY}</td></tr></table>",
    "inline": f"<article><h1>The <em>ti</em>tle</h1><p>{LONG.replace('whole', '<a href=x><b>whole</b></a>')}</p><!-- <p>no</p> --><p>\n Short.\t</p><p>{MORE}</p><p> &nbsp; </p></article>",
    "spans": f"<article><h1>The title</h1><p>{LONG}<span class='ad'>buy <span>this</span> now</span></p><p>Short.</p><p>{MORE}</p></article>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_with_a_known_article(name):
    assert he.lines_of(PAGES[name]) == WANT


def test_blocks_references_and_white_space():
    page = "<article><h1>A &amp; B&lt;c&gt; &#8364;&eacute;</h1><ul><li>one<li>two\n\n three</ul><pre>a\n  b</pre><blockquote>q<br>r</blockquote><dl><dt>t<dd>d</dl><table><tr><td>x<td>y</table></article>"
    assert he.lines_of(page) == ["A & B<c> €é", "one", "two three", "a b", "q r", "t", "d", "x", "y"]


def test_ratios_alone_choose_a_region():
    """No article, no names: the cluster of lines with much text and few tags."""
    links = "<div>" + "".join(f"<a href=/{k}>Link {k}</a> | " for k in range(30)) + "</div>"
    assert he.lines_of(f"<body>{links}<div><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div>{links}</body>") == [LONG, MORE, LONG]


def test_smoothing_is_a_weighted_mean():
    import numpy as np

    x = np.array([0.0, 10, 0, 0, 100, 3])
    want = [sum(he.KERNEL[j + 2] * x[i + j] for j in range(-2, 3) if 0 <= i + j < 6) for i in range(6)]
    assert np.allclose(he.smoothed(x), want) and len(he.smoothed(x[:0])) == 0 and abs(he.KERNEL.sum() - 1) < 1e-12


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p>", "<!--", "<script>", "&", "&#0;&#xD800;&#x110000;", "<![foo[x]]><p>", "<nav>only a menu</nav>", "</div></p></b></article>", "<title>t</title>", "a\x00b"])
def test_odd_pages(page):
    text = he.main_text(page)
    assert isinstance(text, str) and "\n\n" not in text and text.encode() is not None


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "<div>", "</div>", "<article>", "</article>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "</table>", "<head>", "<body>", "<br>", "<hr/>", "<script>", "</script>", "<![x", "<!", "text ", "w", "&amp;", "<h1>", "<nav>", "</nav>", "<form>", "<a>", "</a>"]), max_size=60))
@settings(deadline=None, max_examples=300)
def test_any_sequence_of_tags(parts):
    he.main_text("".join(parts))


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    began = time.perf_counter()
    assert he.lines_of("<div>" * 50_000 + LONG + "</div>" * 50_000) == [LONG]
    assert len(he.lines_of("<article>" + f"<p>{LONG}" * 20_000 + "</article>")) == 20_000
    he.lines_of("<b>" * 50_000 + "</i>" * 50_000 + "x")
    assert time.perf_counter() - began < 20


def plain_article(page):
    """The article of the given pages, which have one each, by its borders alone."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not inner:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", inner.group(1))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks) if x)


def test_the_query_gives_each_page_s_article(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = he.query(spark, SF).collect()
    assert len(got) == len(pages) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain_article(pages[r["page_id"]]["html"]), len(r["text"]))


def test_rows_nulls_and_extra_columns(spark):
    rng = random.Random(1)
    rows = [(1, "u", PAGES["plain"]), (1, "u", PAGES["plain"]), (None, None, None), (2, None, ""), (3, "x", "<article>" + "".join(f"<p>{rng.random()}" for _ in range(9000)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS id", "2 AS n_chars")
    got = he.extract(df).collect()
    assert sorted(((r["page_id"] or 0, r["n_chars"]) for r in got)) == sorted((i or 0, len(he.main_text(h))) for i, _, h in rows)
    assert he.extract(df.where("page_id < 0")).count() == 0
