"""Layouts of pages in which more than one container holds the article."""

from __future__ import annotations

import re
import time
from html import unescape

import numpy as np
import pytest

from draftlens.llm import htmltext

LONG, SHORT = ("long words " * 200).strip(), ("short words " * 20).strip()


def test_main_and_its_article_are_one_container():
    page = f"<body><nav>Menu</nav><main><h1>Title</h1><p>Lead.</p><article><p>{LONG}</p></article></main><footer>Foot</footer></body>"
    assert htmltext.main_text(page) == f"Title\n\nLead.\n\n{LONG}"


def test_a_short_article_stays_beside_a_long_one():
    page = f"<body><article><p>{LONG}</p></article><article><h2>Two</h2><p>{SHORT}</p></article></body>"
    assert htmltext.main_text(page) == f"{LONG}\n\nTwo\n\n{SHORT}"


def test_a_teaser_does_not_outweigh_the_text_in_plain_divs():
    page = f"<body><div><h1>Title</h1><p>{LONG}</p><p>End.</p></div><article><p>{SHORT}</p></article></body>"
    assert htmltext.main_text(page) == f"Title\n\n{LONG}\n\nEnd.\n\n{SHORT}"
    beside = f"<body><div><p>{SHORT}</p></div><article><p>{LONG}</p></article></body>"
    assert htmltext.main_text(beside) == LONG


PROSE = ("Some words that go on for a while. " * 9).strip()


@pytest.mark.parametrize(
    "page,want",
    [
        ('<body><div class="layout has-sidebar"><article><h1>Title</h1><p>Some text here.</p></article></div></body>', "Title\n\nSome text here."),
        ('<body><div class="social science"><p>Words about science that go on.</p></div></body>', "Words about science that go on."),
        ('<body><div id="main" class="search"><h1>T</h1><p>Words about.</p></div></body>', "T\n\nWords about."),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>x y z</p></article>', "Title\n\nx y z"),
        ('<article><p>Real text <span class="advert">BUY NOW</span> more</p></article>', "Real text more"),
        ('<article><p>Important paragraph. <span class="share">Share</p><p>Next.</article>', "Important paragraph.\n\nNext."),
        ('<article>Intro words <span class="social"><div>fb</div></span> tail</article>', "Intro words\n\ntail"),
        (f"<body><div><a>A</a> <a>B</a> <a>C</a></div><div><h1>Title</h1><p>{PROSE}</p><p>End.</p></div><div>Terms Privacy</div></body>", f"Title\n\n{PROSE}\n\nEnd."),
        (f"<body><div><p>{LONG}</p><div><a>A</a> <a>B</a> <a>C</a></div><p>{LONG}</p></div><div>Terms Privacy</div></body>", f"{LONG}\n\n{LONG}"),
        (f'<body><form><div class="wrap"><div><h1>T</h1></div><div><p>{LONG}</p></div></div></form><div class="comments">{PROSE}</div></body>', f"T\n\n{LONG}"),
        (f'<body><article><h1>A</h1><p>Short.</p></article><div class="comments"><p>{LONG}</p></div></body>', "A\n\nShort."),
    ],
)
def test_layouts(page, want):
    assert htmltext.main_text(page) == want


def plain(html):
    """The pages of the test tables all have one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", re.sub("<!--.*?-->", "", html), re.S)[1]
    blocks = re.split("</?(?:p|h1)>", inner)
    texts = (" ".join(unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in blocks)
    return "\n\n".join(t for t in texts if t)


def test_pages_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(pages).collect()}
    assert got == {r["page_id"]: plain(r["html"]) for r in pages.collect()}


def test_smoothed_ratios_decide(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = [htmltext.main_text(p) for p in pages]
    page = f"<body><div><a>A</a> <a>B</a></div><div><p>{PROSE}</p></div><div>Terms</div></body>"
    kept, method = htmltext.main_text(page), htmltext.smoothed
    monkeypatch.setattr(htmltext, "smoothed", lambda r, sigma: -method(r, sigma))
    assert htmltext.main_text(page) != kept == PROSE
    assert sum(htmltext.main_text(p) != x for p, x in zip(pages, right, strict=True)) > len(pages) / 2
    monkeypatch.setattr(htmltext, "smoothed", lambda r, sigma: np.zeros(len(r)))
    assert htmltext.main_text(page) != kept
    rng = np.random.default_rng(4)
    monkeypatch.setattr(htmltext, "smoothed", lambda r, sigma: rng.random(len(r)) * 8)
    assert htmltext.main_text(page) != kept or [htmltext.main_text(p) for p in pages] != right


@pytest.mark.parametrize("page", ["<b>{n}x</i>{n}", "<div>{n}x</p>{n}", "<p>y</span>{n}", "<span><div>x</span>{n}"])
def test_time_is_linear_in_broken_pages(page):
    def seconds(n):
        start = time.process_time()
        htmltext.main_text("".join(x * n for x in page.split("{n}")))
        return time.process_time() - start

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)


PARAGRAPH = "A long paragraph of prose that says what the page is about, in several clauses, and goes on for a while so that it has weight. "


def test_short_siblings_and_chapters_stay():
    """A short block between long ones of the same parent, and chapters whose names only hold a word of menus and notices."""
    page = f"<body><div>{PARAGRAPH}</div><div>Second part.</div><div>{PARAGRAPH}</div></body>"
    assert htmltext.main_text(page).split("\n\n")[1] == "Second part."
    for start, end in (('<section class="related-work">', "</section>"), ('<div id="search-algorithms">', "</div>"), ('<p class="legal-notice-period">', "</p>")):
        text = htmltext.main_text(f"<article><p>{PARAGRAPH}</p>{start}<p>Chapter text that belongs here.</p>{end}<p>{PARAGRAPH}</p></article>")
        assert "Chapter text" in text, start
    for name in ("ad", "ad-slot", "related-posts", "post-share", "newsletter-signup", "comments", "cookie notice"):
        text = htmltext.main_text(f'<article><p>{PARAGRAPH}</p><div class="{name}">Buy or read this instead.</div><p>{PARAGRAPH}</p></article>')
        assert "instead" not in text, name


def test_unterminated_markup_takes_linear_time():
    for unit in ('<a href="', "<!--", "<a <b", "<![CDATA[", "<?x", "</"):
        took = []
        for n in (4_000, 40_000):
            began = time.process_time()
            htmltext.main_text(f"<p>{PARAGRAPH}</p>" + unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 3, (unit, took)
    assert htmltext.main_text(f"<p>{PARAGRAPH}</p><!-- a comment without end <p>gone</p>") == PARAGRAPH.strip()
    assert htmltext.main_text(f"<p>{PARAGRAPH} 3 < 4</p>").endswith("3 < 4")
