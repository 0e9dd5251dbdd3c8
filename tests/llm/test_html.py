"""HTML extraction: exact marginals by enumeration, held-out pages, markup of all sorts."""

from __future__ import annotations

import html as references
import itertools
import re

import numpy as np

from homologrid.llm import html
from homologrid.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def article_text(page):
    """The article element of these tables' pages, whose blocks are its headings and paragraphs."""
    (body,) = re.findall(r"<article>(.*)</article>", page, re.S)
    blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", body))
    flat = (" ".join(references.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in flat if b)


def brute_marginals(woods, model):
    count = len(woods.parent)
    nodes = np.add.reduceat(model.nodes[woods.marks], woods.bounds[:-1])
    total = np.zeros((count, 3))
    for states in itertools.product(range(3), repeat=count):
        score = sum(nodes[i, s] for i, s in enumerate(states))
        for i, up in enumerate(woods.parent):
            if up >= 0:
                score += model.edges[woods.kind[i], states[up], states[i]]
        for i, s in enumerate(states):
            total[i, s] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_give_the_marginals_of_all_states():
    rng = np.random.default_rng(1)
    model = html.Model(rng.normal(size=(html.FEATURES, 3)), rng.normal(size=(4, 3, 3)))
    for page in ("x", "<div>a<p>b <i>c</i></div>d", "<ul><li>a<li>b</ul><p class=ad>c"):
        woods = html.forest([html.parsed(page)])
        found, pair = html.marginals(woods, model)
        want = brute_marginals(woods, model)
        assert np.allclose(found, want)
        for i, up in enumerate(woods.parent):
            if up >= 0:
                assert np.allclose(pair[i].sum(axis=1), want[up]) and np.allclose(pair[i].sum(axis=0), want[i])


def test_pages_of_the_table_give_their_articles(spark):
    given = {r.page_id: r for r in table(spark, FOLDER, "pages").collect()}
    out = html.op11_html_text(spark, FOLDER)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert sorted(r.page_id for r in rows) == sorted(given)
    exact = sum(r.text == article_text(given[r.page_id].html) for r in rows)
    assert exact == len(rows)
    assert all(r.n_chars == len(r.text) and r.url == given[r.page_id].url for r in rows)


def test_held_out_layouts():
    pages = html.composed_pages(300, seed=1234)
    texts = html.main_texts([p for p, _ in pages], html.default_model())
    exact = sum(sorted(" ".join(c).split()) == sorted(t.split()) for (_, c), t in zip(pages, texts))
    assert exact >= 0.95 * len(pages)


PAGE = """<!doctype html><html><head><title>no</title><script>if (a < b) document.write("<p>no</p>")</script></head>
<body class="home"><header class=site-header><a href=/>Brand</a><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav></header>
<div class="cookie-notice" id="c1">We use cookies.<button>Fine</button></div>
<article><h1>A  title &amp; more</h1>
<p>First&nbsp;paragraph with <b>bold</b> and <a href="/x?a=1>2">a link</a>, long enough to read. It has sentences.
<p>Second &lt;one&gt; &#8212; still
  going on.<br>After the break it ends here.</p><!-- <p>no</p> -->
<div class="ad">Buy this now!</div>
<ul><li>An item of the list.<li>Another item of the list.</ul>
<blockquote>Somebody said so, at length and with care.</blockquote></article>
<section id="comments"><div class="comment"><b>joe</b><p>Nice one, I liked it a lot.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Other story</a></li></ul></aside>
<form><label>Search</label><input><button>Go</button></form><footer>&copy; Us. All rights.</footer>"""

TEXT = (
    "A title & more\nFirst paragraph with bold and a link, long enough to read. It has sentences.\n"
    "Second <one> — still going on. After the break it ends here.\nAn item of the list.\nAnother item of the list.\n"
    "Somebody said so, at length and with care."
)


def test_a_page_with_all_parts():
    same = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    assert html.main_texts([PAGE, same], html.default_model()) == [TEXT, TEXT]


def test_odd_pages_and_columns(spark):
    deep = "<div>" * 3000 + "text " * 30 + "."
    odd = [None, "", "   ", "<", "<p", "<!--", "<p class='", "<script>x", "a < b & c", "</p></div>", deep, PAGE, PAGE]
    odd.append("<article><p>" + "word after word. " * 60_000 + "</p></article>")
    rows = [(i, h, "mine", h) for i, h in enumerate(odd)]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string, `n_chars` string")
    out = html.with_main_text(pages, into=("main", "size"))
    assert out.columns == ["page_id", "html", "text", "n_chars", "main", "size"]
    found = {r.page_id: r for r in out.collect()}
    assert len(found) == len(odd)
    assert [found[i].main for i in range(3)] == [""] * 3
    assert found[11].main == found[12].main == TEXT and found[11].html == PAGE
    assert found[13].size == len("word after word. " * 60_000) - 1
    assert all(r.size == len(r.main) and r.text == "mine" for r in found.values())
    assert html.with_main_text(pages.limit(0), into=("main", "size")).count() == 0


def test_many_open_ends_take_linear_time():
    page = "<p><b>x<i>y" * 20_000 + "</b>" * 20_000
    assert len(html.parsed(page).texts) == 40_000
