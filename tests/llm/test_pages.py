import html
import itertools
import re

import numpy as np
import pytest

from geoloom.llm import labelled_pages, pages
from geoloom.llm.queries import page_model


@pytest.fixture(scope="module")
def model():
    return page_model()


def text(page, model):
    return pages.texts([page], model)[0]


def shown(page):
    """All text of a page, as if every node were content."""
    tree = pages.parsed(page)
    return pages.main_text(tree, np.ones(len(tree.parent)))


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        tree = pages.Tree()
        for p in parent:
            tree.node(p, ["div", "p", "nav"][rng.integers(0, 3)], [], False, 0, 0)
        other = pages.Tree()
        other.node(-1, "p", [], False, 0, 0)
        f = pages.forest([other, tree], {}, learn=True)
        own, edges = rng.normal(size=n + 1) * 2, rng.normal(size=(pages.KINDS, 2, 2)) * 2
        marginal, both = pages.messages(f, own, edges)
        total, single, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(own[1 + i] * s for i, s in enumerate(states)) + sum(edges[f.kind[1 + i], states[p], states[i]] for i, p in enumerate(parent) if p >= 0))
            total += w
            single += w * np.array(states)
            for i, p in enumerate(parent):
                if p >= 0:
                    pairs[i, states[p], states[i]] += w
        assert np.allclose(marginal[1:, 1], single / total) and np.allclose(both[1:], pairs / total)
        assert np.isclose(marginal[0, 1], 1 / (1 + np.exp(-own[0])))


def test_training_follows_the_gradient():
    # The trained potentials are where seen and expected counts meet: tags that are always or never content get clear signs.
    model = pages.train(["<article data-content=1><p>a b</p></article><nav>c</nav>"] * 3 + ["<nav>c d</nav><article data-content=1><p>e</p></article>"], penalty=1e-6)
    trees = [pages.parsed("<nav>x y</nav><article><p>z</p></article>")]
    p = dict(zip(trees[0].tag, pages.marginals(trees, model)[0], strict=True))
    assert p["article"] > 0.95 and p["p"] > 0.95 and p["nav"] < 0.05 and p["#page"] < 0.05
    assert pages.texts(["<p>x</p>"], pages.train([]))[0] in ("", "x")


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a<p>b", "a\nb"), ("<div>a<p>b</p>c</div>", "a\nb\nc"), ("<p>a<br>b <b>c</b>d</p>", "a b cd"), ("<p>x &amp; y &copy;&nbsp;z &lt;b&gt; &am", "x & y © z <b> &am"),
    ("<p> \n a\t b \r\n</p>", "a b"), ("a<!-- b --><!-->c<!-- d", "ac"), ("<p>a</p><scr", "a"), ("<p>a<script>if (1 < 2) '</p>';</script>b<style>p{}</style></p>", "ab"), ("<title>no</title><textarea>no</textarea><p>yes", "yes"),
    ("<p class='x>y' title=\"a>b\">c</p>", "c"), ("<a href=x'y>z</a>", "z"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b\nc\nd"), ("<b><p>a</b>b</p>c", "ab\nc"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("</p></div>a</>b<?x y?>c<!doctype html>d", "abcd"), ("<P>A</P><BR/>B", "A\nB"), ("<svg><text>no</text></svg><noscript>no</noscript><button>no</button>a", "a"), ("<h1>t</h1>x<hr>y", "t\nx\ny"),
    ("<select><option>a<option>b</select>c", "c"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<p>a<iframe>no", "a"), ("", ""), (None, ""),
])
def test_parsing(page, want):
    assert shown(page) == want


def test_odd_pages_end_in_time(model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    for page in (deep, "<b>" * 20_000 + "<div>" * 500, "<" * 50_000, "<p " * 20_000, "<a href=\"" * 20_000, "&" * 50_000, "<!--" * 20_000, "<p>" + "word " * 400_000 + "</p>", "<li>" * 5_000, "</div>" * 50_000):
        text(page, model)


NEWS = """<!doctype html><html><head><title>T</title></head><body class="home"><div id="cookie-consent-banner"><p>We use cookies to improve your visit. Accept them.</p><button>OK</button></div>
<header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport today</a></li></ul></nav></header>
<div class="layout"><main id="main"><h1>Rain over the hills</h1><p>The rain came down for three days, and the river <a href="/r">rose</a> by a metre.</p><div class="advertisement">Buy our umbrellas now.</div>
<p>Nobody was hurt.</p><blockquote>It was wet, said one.</blockquote></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One story of old</a></li><li><a href="/2">Another story</a></li></ul></aside></div>
<section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I was there and it was terrible, really terrible.</p></div></section><footer><p>&copy; The Daily. All rights reserved.</p></footer></body></html>"""
NEWS_TEXT = "Rain over the hills\nThe rain came down for three days, and the river rose by a metre.\nNobody was hurt.\nIt was wet, said one."
BLOG = """<body><div id="header"><h1>My blog</h1></div><ul class="nav"><li><a href="/">Home</a><li><a href="/about">About me</a></ul><form action="/s"><label>Search</label><input name=q></form>
<div class="post"><h2>On bread</h2><div class="post-body"><p>Bread wants time.<p>Flour, water and salt:<ul><li>flour<li>water<li>salt</ul></div></div>
<div class="comments-area"><ol><li><p>Lovely post, thank you.</p></li><li><p>I disagree with all of it.</p></li></ol></div><div id="footer">Powered by nothing</div></body>"""
BLOG_TEXT = "On bread\nBread wants time.\nFlour, water and salt:\nflour\nwater\nsalt"


def test_pages_of_other_sites(model):
    assert text(NEWS, model) == NEWS_TEXT
    assert text(BLOG, model) == BLOG_TEXT
    short = "<nav><a href=a>a</a></nav><article><h1>Hi</h1><p>Yo</p></article><footer>f</footer>"
    assert text(short, model) == "Hi\nYo"


def test_held_out_pages(model):
    # Made from another seed; the words don't matter, the parts are put together otherwise.
    some = labelled_pages.pages(300, seed=77)
    right = wrong = lost = 0
    for page, got in zip(some, pages.texts(some, model), strict=True):
        tree = pages.parsed(page)
        want = set(pages.main_text(tree, np.array(tree.label, float)).split("\n"))
        got = set(got.split("\n"))
        right, wrong, lost = right + len(got & want), wrong + len(got - want), lost + len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + lost) > 0.97


def plain(page):
    """The article of the tables' pages, which all mark it, by cutting."""
    inner = page.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    from geoloom.llm.queries import op12_html_extraction

    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op12_html_extraction(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    assert all((r.text, r.url, r.n_chars) == (plain(rows[r.page_id].html), rows[r.page_id].url, len(r.text)) for r in got)


def test_nulls_repeats_and_extra_columns(spark, model):
    rows = [(1, "u", None, "x", 1), (None, None, "", "x", 1), (3, "u", NEWS, "x", 1), (3, "u", NEWS, "y", 2), (4, "é", "<article><p>d\U0001f600é", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((tuple(r) for r in pages.extracted(df, model).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (None, None, "", 0), (3, "u", NEWS_TEXT, len(NEWS_TEXT)), (3, "u", NEWS_TEXT, len(NEWS_TEXT)), (4, "é", "d\U0001f600é", 3)], key=str)
    assert pages.extracted(df.limit(0), model).count() == 0
