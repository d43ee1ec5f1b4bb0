"""Main text: cuts against all labellings, whole pages of several layouts, malformed and very long markup."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from hippolake.llm import main_text
from hippolake.llm.html_blocks import Reader

SAID = main_text.fit_cells(np.zeros(main_text.CELLS), np.zeros(main_text.CELLS))
PARAGRAPHS = [
    "The council met on Monday to discuss the new library, which opens in spring after three years of work.",
    "Many residents came to the meeting, and most of them spoke in favour of longer opening hours.",
    "A first vote is planned for the end of the month.",
]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
EXPECTED = " ".join(PARAGRAPHS)


def text_of(page):
    return main_text.main_text(page, SAID)


def cost_of(labels, costs, edges):
    return sum(-c for c, content in zip(costs, labels, strict=True) if content) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cuts_are_least():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.choice([rng.uniform(-3, 3), float(rng.randint(-2, 2))]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.25, 0.5, 1.0, 2.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        found = main_text.minimum_cut(costs, edges)
        least = min(cost_of(labels, costs, edges) for labels in itertools.product([False, True], repeat=n))
        assert cost_of(found, costs, edges) == pytest.approx(least)
        assert cost_of(main_text.max_flow(costs, edges), costs, edges) == pytest.approx(least)


NAV = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul>"
LAYOUTS = {
    "semantic": f"<html><head><title>T</title></head><body><header><h1>Daily</h1>{NAV}</header><nav>{NAV}</nav><main><article>{ARTICLE}</article></main><aside><p>Subscribe to our letter, which comes each week.</p></aside><footer>&copy; Daily</footer></body></html>",
    "names": f"<body class='has-sidebar'><div id=site-header>{NAV}</div><div id=page-wrapper><div class='post-content'>{ARTICLE}</div><div class=sidebar><p>The most read text of the week is about the new bridge and its many builders.</p></div></div><div class=comments><p>I was there too, and I must say that the hall was far too small for so many people.</p></div><div id=footer><p>All rights reserved.</p></div>",
    "plain": f"<body><div>{NAV}</div><div>{ARTICLE}</div><div>&copy; 2020 The Daily</div>",
    "comments in the article": f"<article>{ARTICLE}<section id='comments'><article class=comment><p>I was there too, and I must say that the hall was far too small.</p></article></section><footer>Filed under news</footer></article>",
    "advert in the article": f"<article><p>{PARAGRAPHS[0]}</p><div class='ad-slot'><p>Buy our fine new shoes today, and get the second pair for free, this week only.</p></div><p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></article>",
    "forms": f"<form action=/><article>{ARTICLE}</article></form><form><label>Your e-mail address, so that we can write to you.</label><input><select><option>One<option>Two</select><button>Send</button></form>",
    "notices": f"<div role=alert>We use cookies.</div><div class='cookie-banner'><p>We use cookies to make this page work for you as well as it can. You agree by reading on.</p></div><div id=content>{ARTICLE}</div><div hidden>Not shown to anyone.</div><noscript>Please enable scripts.</noscript>",
    "scripts": f"<script>var a = '<article><p>no</p></article>';</script><style>p {{ color: red }}</style><article>{ARTICLE}<script>x('</p>')</script><!-- <p>gone</p> --></article><script>unclosed <p>text</p>",
    "unclosed": f"<article><p><b>{PARAGRAPHS[0]}<br><p>{PARAGRAPHS[1]}<p>{PARAGRAPHS[2]}</article><footer>Bye",
    "list of links": f"<div class=related><a href=1>{PARAGRAPHS[0]}</a></div><article>{ARTICLE}</article><div><a href=2>{PARAGRAPHS[1]}</a> <a href=3>Another text on libraries</a></div>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    assert text_of(LAYOUTS[name]) == EXPECTED


def test_text_of_blocks():
    page = "<article><h1>A&amp;B &am &amp</h1>x<b>y</b>z <i>&lt;w&gt;</i>\n\t<span>1</span> &nbsp;2<div>three<p>four</div><table><tr><td>5<td>6</table><ul><li>seven<li>eight</ul>a < b &#8364;&#x20AC; &quot;q&quot;</article>"
    assert text_of(page) == "A&B &am & xyz <w> 1 2 three four 5 6 seven eight a < b €€ \"q\""
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == ""


@pytest.mark.parametrize("broken", ["<" * 5, "<a b='", "<!--", "<!", "</", "</ x>", "<script>", "<p", "<p a=\"1", "<title>", "&#0;&#xD800;&#99999999;", "</p></div></td></body>", "<td></div></td>"])
def test_broken_tails(broken):
    got = text_of(f"<article>{ARTICLE}</article>{broken}")
    assert got.startswith(EXPECTED)


LONG = ["<div>", "<p>", "</p>", "<", "<a b='x\" c=\"", "<!-", "<!--", "<b>", "<li>", "</li>", "<li></li>", "<table>", "<tr><td>", "</td>", "<i><div>", "</i>", "<svg>", "<a>", "x<br>", "<p>word ", "<div>a</div>", "<ul><li>a", "</div>", "&amp", "<section><p>One more sentence.", "</x"]


@pytest.mark.parametrize("unit", LONG)
def test_long_pages_take_time_in_proportion(unit):
    began = time.perf_counter()
    Reader(main_text.place).read(unit * 100_000)
    assert time.perf_counter() - began < 20
    text_of("<ul><div>" + unit * 20_000)
    assert time.perf_counter() - began < 40


def test_rows(spark):
    rows = [(1, "u", LAYOUTS["names"], "x"), (1, None, LAYOUTS["names"], "x"), (None, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<article>" + ARTICLE * 20_000, "x"), (4, "u", "é", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = main_text.extract(pages).collect()
    assert [(r.page_id, r.url) for r in found] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in found[:4]] == [EXPECTED, EXPECTED, "", ""] and found[4].text == " ".join([EXPECTED] * 20_000)
    assert all(r.n_chars == len(r.text) for r in found)
    assert main_text.extract(pages.limit(0)).count() == 0


def test_the_fit_learns_from_certain_places(spark):
    pages = spark.createDataFrame([(i, "u", LAYOUTS["semantic"]) for i in range(50)], "page_id long, url string, html string")
    said = main_text.fit(pages)
    assert not np.allclose(said, SAID) and main_text.main_text(LAYOUTS["plain"], said) == EXPECTED
