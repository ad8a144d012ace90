"""Main text: pages built from known articles, and the rules case by case."""

from __future__ import annotations

import html
import re

import pytest

from strandline.llm.html_text import Rules, extract, first_labels, main_text, page_blocks, settled
from strandline.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
LONG = "It is said that the people of the town were on the way to a new life and that it was not for all"
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body class="post">
<div id="cookie-notice">{long}</div><header class="site-header"><h1>Site</h1><p>{long}</p></header>
<nav><ul><li><a href="/">Home of the site</a></ul></nav><div class="leftSidebar"><p>{long}</p></div>
{open}<h2>A title</h2><p>To.</p><p>{long} &amp; &lt;b&gt;&nbsp;&eacute;</p><!-- <p>{long}</p> -->
<script>var a = "</p><p>{long}";</script><p>Short   <b>o</b>ne.<ul><li>First <a href=x>point</a><li>Second</ul>
<form><p>{long}</p></form><blockquote>What it was.</blockquote><aside>{long}</aside>{close}
<section id="comments"><article class="comment"><p>{long}</p></article></section>
<div class="related-posts"><p>{long}</p></div><div style="display: none">{long}</div>
<div class="ad">{long}</div><footer>{long}</footer></body></html>"""
WANT = ["A title", "To.", LONG + " & <b> é", "Short one.", "First point", "Second", "What it was."]


@pytest.mark.parametrize(
    "open_,close",
    [("<article>", "</article>"), ("<main role=main><div>", "</div></main>"), ("<div class='x'>", "</div>")],
)
def test_page_furniture_goes(open_, close):
    assert main_text(PAGE.format(long=LONG, open=open_, close=close)) == "\n\n".join(WANT)


def test_open_blocks_follow_their_neighbours():
    page = f"<div><p>{LONG}</p><p>ok</p></div><div><p>{'word ' * 60}</p><p>no</p></div>"
    blocks = page_blocks(page)
    labels = first_labels(blocks, Rules())
    assert labels == [1, None, 0, None]
    assert settled(blocks, labels) == [1, 1, 0, 0]
    assert main_text("<p>lonely</p>") == ""


def test_menu_that_is_not_closed():
    assert main_text(f"<nav><ul><li><a href=x>x</a><article><p>{LONG}</p></article>") == LONG


def test_broken_and_long_pages():
    for page in ["<", "<p", "<p>" + LONG, "<!-- open", "<script>x", "a<b>c</div></div>", "<p a='>'>x", "\x00<p>"]:
        assert isinstance(main_text(page), str)
    assert main_text("<p>" + LONG) == LONG
    for tag in ("<a title='a > b' x>", '<a title="5" tall">', "<a d=it's>", '<img alt="<b>" src=x>', "<a =\"'>"):
        assert main_text(f"<p>{LONG} {tag}end</p><p>{LONG}</p>") == f"{LONG} end\n\n{LONG}"
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n\n") == 19_999
    assert main_text("<div>" * 20_000 + f"<p>{LONG}</p>") == LONG


def test_rows(rows):
    page = f"<article><p>{LONG}</p></article>"
    data = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<nav>x</nav>")]
    got = extract(rows(SCHEMA, [(*r, "old", "old") for r in data])).collect()
    want = [(i, u, LONG if h == page else "", len(LONG) if h == page else 0) for i, u, h in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert extract(rows(SCHEMA, [])).collect() == []


def test_query_gives_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op1_block_rules"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", article))
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p)
        assert r.n_chars == len(r.text)


def test_rules_decide_inside_articles():
    """The article tag lowers the limits; density, length and neighbours decide."""
    code = "x1 q2 z3 " * 40
    page = f"<main><p>{LONG}</p><p>ok</p><p>{code}</p></main><div><p>{code}</p><p>no</p></div>"
    blocks = page_blocks(page)
    labels = first_labels(blocks, Rules())
    assert labels == [1, None, None, 0, None]
    assert settled(blocks, labels) == [1, 1, 1, 0, 0]
    assert main_text("<article><p>only this</p></article>") == "only this"
    half = LONG[:40]
    assert first_labels(page_blocks(f"<article>{half}</article>"), Rules()) == [1]
    assert first_labels(page_blocks(f"<div>{half}</div>"), Rules()) == [None]


def test_pages_without_article_marks(spark, small):
    """Without the tag nearly all texts are the same: most blocks are decided by the rules."""
    pages = [r.html for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet").collect()]
    same, decided, total = 0, 0, 0
    for page in pages:
        bare = re.sub(r"</?(?:article|main)[^>]*>", "", page)
        same += main_text(bare) == main_text(page)
        blocks = page_blocks(page)
        total += sum(not b.furniture for b in blocks)
        labels = first_labels(blocks, Rules())
        decided += sum(x is not None and not b.furniture for x, b in zip(labels, blocks, strict=True))
    assert same >= 0.8 * len(pages)
    assert 0.5 * total < decided < total  # the others follow their neighbours
