import itertools
import re
import time
from html import unescape

import numpy as np
import pytest

from shelfscope.llm.html_extract import aligned, extract, fit, main_text, marginals, parse

ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Top</header>%s<aside>side</aside><form>Name <input></form><footer>&copy; x</footer></body></html>"


def text_of(html):
    return extract([parse(html)], fit({}))[0]


@pytest.mark.parametrize(("html", "want"), [
    (ARTICLE % "<article><h1>A&amp;B</h1><p>one<b>two</b> three\n four<br>five<p>six</article>", "A&B onetwo three four five six"),
    (ARTICLE % "<article><p>x</p><div class='ad'>buy</div><section id=comments><p>nice post</p></section><script>var a='</p>';</script><p>y &#233;&nbsp;&lt;z&gt;</p></article>", "x y é <z>"),
    (ARTICLE % "<main><p>Long text with several words in it, <a href=y>a link</a> too.</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "Long text with several words in it, a link too. a b 1 2"),
    (ARTICLE % "<!-- <article><p>no</p></article> --><article><!-- no --><p>yes</p><p title=\"a>b\">so</p></article>", "yes so"),
    (ARTICLE % "<article><p>1 < 2 & 3 &amp;lt; <p><b>bold<p>next</article>", "1 < 2 & 3 &lt; bold next"),
    (ARTICLE % "<article><div class='cookie-notice'><p>We use cookies</p></div><p>body text</p><nav>n</nav></article>", "body text"),
    ("", ""), ("<", "<" * 0), ("<p", ""), ("<article>open", "open"), ("<article><script>never closed <p>x", ""), ("<article><!-- never closed <p>x", ""),
    ("<nav>" * 3000 + "x", ""), ("<article>" + "<div>" * 20 + "deep", "deep"),
])
def test_pages(html, want):
    assert text_of(html) == want


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    inline, odds, edge = rng.integers(0, 2, 8), rng.normal(0, 2, 8), rng.normal(0, 1, (2, 2, 2))
    total = np.zeros((8, 2))
    for labels in itertools.product((0, 1), repeat=8):
        weight = np.exp(sum(odds[i] * y for i, y in enumerate(labels)) + sum(edge[inline[i], labels[parent[i]], labels[i]] for i in range(8) if parent[i] >= 0))
        for i, y in enumerate(labels):
            total[i, y] += weight
    assert np.allclose(marginals(parent, inline, odds, edge), total[:, 1] / total.sum(1))


def test_given_pages(corpus_session):
    pages = corpus_session.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["__id"]: r for r in main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want = " ".join(unescape(re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside))).split())
        assert got[r.page_id]["text"] == want and got[r.page_id]["n_chars"] == len(want) and got[r.page_id]["url"] == r.url


def test_odd_pages(corpus_session):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<article><p>x</article>"), (3, "u", "<article><p>" + "long word " * 50_000)]
    pages = corpus_session.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((str(r["__id"]), len(r["text"])) for r in main_text(pages).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("3", 499_999), ("None", 1)]
    assert main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["<a ", "<b>", "</i>", "<div>", "<li>", '<a b="> "', '<a "> "', "<a b='", "<svg/>", "<", "</script ", "<b><div></div>", "<!-"])
def test_parser_is_linear(unit):
    for before in ("", "<script>", "<ul>" + "<div>" * 20_000, "<b>" * 20_000):
        began = time.process_time()
        parse(before + unit * ((1 << 20) // len(unit)) + "</p>" * 1000)
        assert time.process_time() - began < 6


def test_quotes_left_open():
    page = '<article><p title="a>b">one</p><p title="c>two</p><p>three</p></article>'
    assert text_of(page) == "one two three"
    assert text_of("<article><p it's>it's</p><p>x</p></article>") == "it's x"


def test_pages_without_an_article_element():
    paragraphs = "".join(f"<p>Some sentence number {i} with enough words in it to be read.</p>" for i in range(5))
    page = f"<body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div><h1>Head</h1>{paragraphs}</div><footer>foot</footer></body>"
    pages = [parse(page)]
    known = aligned(pages[0], "Head" + re.sub("<[^>]+>", " ", paragraphs))
    assert known is not None and [t for t, k in zip(pages[0].tag, known, strict=True) if k and t not in ("body", "#root")] == ["div", "h1"] + ["p"] * 5
    assert aligned(pages[0], "other text") is None


def test_labelled_pages_overrule_a_listed_word(corpus_session):
    text = "A body of text that stands in a block of this name"
    site = [f"<body><nav>menu</nav><div class='related work'><p>{text} {i}</p></div><div class='ad'>buy {i}</div></body>" for i in range(1500)]
    pages = corpus_session.createDataFrame([(i, h) for i, h in enumerate(site[:5])], "page_id long, html string")
    assert {r["text"] for r in main_text(pages).collect()} == {""}
    labelled = corpus_session.createDataFrame([(h, f"{text} {i}") for i, h in enumerate(site)], "html string, text string")
    got = {r["__id"]: r["text"] for r in main_text(pages, labelled=labelled).collect()}
    assert got == {i: f"{text} {i}" for i in range(5)}
