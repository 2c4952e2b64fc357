"""Main text of pages: the field against enumeration, held-out pages, and a plain reading of the given pages."""
import html
import itertools
import random
import re

import numpy as np
import pytest
from helpers import same

from barlab.llm import extraction, queries, sample_pages
from barlab.llm.leaves import Leaf, labelled, leaves, read


@pytest.fixture(scope="module")
def field():
    return extraction.learn(labelled(sample_pages.pages(0, extraction.Setup().pages)))


def texts(page):
    return [b.text for b in leaves(page)[1]]


def test_leaf_blocks():
    assert texts(None) == texts("") == texts(" <p> \n</p><br>") == []
    assert texts("a&amp;b &lt;p&gt;&nbsp;\n c<p>d<b>e</b>f<br>g<p>h") == ["a&b <p> c", "def g", "h"]
    assert texts('<script>var t="</p><p>x";</script>y<style>p{}</style><!-- <p>no --><textarea>q</textarea>') == ["y"]
    assert texts('<a title="1 > 0" href=x>one</a><div hidden>no</div><div style="display: none"><p>no</p></div>two') == ["one", "two"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d</div></p></b>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table><h2>x</h3>y") == ["a", "b", "c", "x", "y"]
    assert texts("a<!-- never closed <p>b") == ["a"] and texts("<script>x") == [] and texts("5 < 6 and <b") == ["5 < 6 and <b"]
    assert texts('<a href="x>y</a><p>z') == ["y", "z"]
    b = leaves('<div class="Side-Bar" id=x1><p>a<p>b</div><p class=ad>c')[1]
    assert [(x.sibling, ".side" in x.around, ".ad" in x.around) for x in b] == [(False, True, False), (True, True, False), (False, False, True)]
    assert leaves("<title> A &amp; B </title><p>x")[0] == "A & B"


def test_long_and_deep_pages(field):
    assert len(texts("<div>" * 100_000 + "x" + "</div>" * 100_000)) == 1
    long = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>Sentence number {i}, which is part of the article.</p>" for i in range(60_000)) + "</article><footer>&copy; x</footer>"
    assert extraction.main_text(long, field) == "\n".join(f"Sentence number {i}, which is part of the article." for i in range(60_000))
    assert texts("<p title='" * 20_000) == ["<p title='" * 20_000] and texts("<p title='" * 20_001 + ">") == []
    one = "word " * 1_000_000
    assert extraction.main_text(f"<article><h1>T</h1><p>{one}</p></article>", field).endswith(one.strip())


def test_likelihood_and_gradients():
    rnd = np.random.default_rng(3)
    n, width = 4, 5
    e, size = rnd.normal(size=(n, width)), np.array([5, 1, 3, 2])
    sibling, y = rnd.integers(0, 2, (n, width)), rnd.integers(0, 2, (n, width))
    start, turn = rnd.normal(size=2), rnd.normal(size=(2, 2, 2))

    def path(i, labels):
        s = start[labels[0]] + sum(e[i, t] for t, v in enumerate(labels) if v)
        return s + sum(turn[sibling[i, t], labels[t - 1], labels[t]] for t in range(1, len(labels)))

    def plain():
        total = 0.0
        for i in range(n):
            every = [path(i, p) for p in itertools.product((0, 1), repeat=int(size[i]))]
            total += path(i, tuple(y[i, :size[i]])) - np.logaddexp.reduce(every)
        return total

    value, d_e, d_start, d_turn = extraction.likelihood(e, sibling, y, size, start, turn)
    assert value == pytest.approx(plain())
    for array, grad in ((e, d_e), (start, d_start), (turn, d_turn)):
        for at in np.ndindex(array.shape):
            old = array[at]
            array[at] = old + 1e-5
            up = plain()
            array[at] = old - 1e-5
            assert (up - plain()) / 2e-5 == pytest.approx(grad[at], abs=1e-6)
            array[at] = old


def test_viterbi_finds_the_best_path():
    rnd = random.Random(5)
    for _ in range(50):
        n = rnd.randint(1, 7)
        f = extraction.Field({f"f{i}": rnd.gauss(0, 1) for i in range(n)}, np.array([rnd.gauss(0, 1), rnd.gauss(0, 1)]), np.array([[[rnd.gauss(0, 1) for _ in "ab"] for _ in "ab"] for _ in "ab"]))
        blocks = [Leaf("x", (), (), (), 0, rnd.random() < 0.5, None, [f"f{i}"]) for i in range(n)]
        score = lambda p: f.start[p[0]] + sum(f.weight[f"f{i}"] for i in range(n) if p[i]) + sum(f.turn[int(blocks[i].sibling), p[i - 1], p[i]] for i in range(1, n))
        assert tuple(f.decode(blocks)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_held_out_pages(field):
    right, wrong, missed, whole, pages = 0, 0, 0, 0, labelled(sample_pages.pages(100_000, 300))
    for blocks, y in pages:
        got = field.decode(blocks)
        right += sum(a and b for a, b in zip(got, y))
        wrong += sum(a and not b for a, b in zip(got, y))
        missed += sum(b and not a for a, b in zip(got, y))
        whole += got == y
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.98 and whole / len(pages) > 0.88


def test_parts_of_a_page(field):
    """Each kind of boilerplate, around and inside the article, with names of its own."""
    article = ["A title of a page", "First sentence of the article, which goes on.", "Short.", "Another one follows here."]
    body = f'<article><h1>{article[0]}</h1><p>{article[1]}</p>%s<p>{article[2]}</p><p>{article[3]}</p>%s</article>'
    parts = ["<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", '<div class="ad">Buy this now, it is cheap.</div>', '<aside><h3>More</h3><p>Read also this one, please.</p></aside>',
             '<form action=/s><label>Search</label><input></form>', '<div class="cookie-notice"><p>We use cookies on this site.</p></div>',
             '<section class="comments"><h3>Comments</h3><div class="comment"><p>I like this article very much.</p></div></section>',
             '<footer>&copy; example.com &middot; All rights.</footer>', '<header><div class="logo">Site</div></header>', '<div class="newsletter"><p>Subscribe to our letter.</p></div>']
    for around, inside, after in itertools.product(parts, ["", *parts[1:6]], ["", parts[5], parts[6]]):
        page = f"<html><head><title>{article[0]}</title></head><body>{around}{body % (inside, '')}{after}</body></html>"
        assert extraction.main_text(page, field) == "\n".join(article), page


def plain_article(page):
    """The pages of the given tables have one article element each, of headings, paragraphs and breaks."""
    m = re.search(r"<article>(.*)</article>", page or "", re.S)
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>|<br>", m[1].replace("<b>", ""))) if t) if m else ""


def test_query_over_its_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op11_html_extraction"](spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(r.page_id, r.url, plain_article(r.html), len(plain_article(r.html))) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    same(got.collect(), want)


def test_any_columns_and_rows(spark):
    page = "<html><body><nav><a href=x>m</a></nav><article><h1>Title here</h1><p>One sentence, of some length.</p></article></body></html>"
    d = spark.createDataFrame([(1, "u", page, "r", "t"), (1, "u", page, "r", "t"), (None, None, None, None, None), (2, "u", "", "r", "t"), (3, None, "<p>", "r", "t")], "page_id long, url string, html string, row string, text string")
    out = extraction.with_main_text(d)
    assert out.select("row.*").columns == d.columns
    text = "Title here\nOne sentence, of some length."
    same(extraction.report(d).collect(), [(1, "u", text, len(text)), (1, "u", text, len(text)), (None, None, "", 0), (2, "u", "", 0), (3, None, "", 0)])
    assert extraction.report(d.limit(0)).count() == 0
    assert [r.text for r in extraction.with_main_text(d, training=[]).collect()] == [""] * 5


def test_training_on_pages_of_ones_own(spark):
    pages = [f'<body><div class="zig" data-main="1"><p>Text {i} of the page.</div><div class="zag">Text {i} of the rest.</div></body>' for i in range(20)]
    f = extraction.learn(labelled(pages))
    assert extraction.main_text('<body><div class="zag">New text.</div><div class="zig"><p>Other text.</div></body>', f) == "Other text."
    assert read(pages[0])[0].mark == "1"
