import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prepflow.llm import dom, extraction
from prepflow.llm.dom import Page
from prepflow.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return extraction.train(labelled_pages())


def test_messages_give_the_exact_marginals():
    page = Page("<div><p>one</p><ul><li>two<li>three</ul></div><p>four")
    vocabulary = {}
    forest = extraction.Forest([page, Page("<p>x")], vocabulary, grow=True)
    rng = np.random.default_rng(0)
    unary, edge = rng.normal(size=forest.n), rng.normal(size=(2, 2, 2))
    marginal, joint, log_z = forest.messages(unary, edge)
    weights, total = np.zeros(forest.n), 0.0
    pairs = np.zeros((forest.n, 2, 2))
    for labels in itertools.product((0, 1), repeat=forest.n):
        x = np.array(labels)
        energy = (unary * x).sum()
        for i in range(forest.n):
            if forest.parent[i] >= 0:
                energy += edge[forest.kind[i], x[forest.parent[i]], x[i]]
        w = np.exp(energy)
        total += w
        weights += w * x
        for i in range(forest.n):
            if forest.parent[i] >= 0:
                pairs[i, x[forest.parent[i]], x[i]] += w
    assert np.allclose(marginal, weights / total) and np.isclose(log_z, np.log(total))
    assert np.allclose(joint, pairs / total)


def test_unseen_labelled_pages(model):
    right = runs = whole = 0
    sources = labelled_pages(200, seed=77)
    pages = [Page(s) for s in sources]
    forest = extraction.Forest(pages, model.vocabulary)
    marginal, _, _ = forest.messages(forest.unary(model.weights), model.edge)
    for page, start in zip(pages, forest.starts):
        truth = extraction._labels(page)
        hits = [(marginal[start + i] > 0.5) == (truth[i] == 1) for i, t in enumerate(page.text) if t]
        right, runs, whole = right + sum(hits), runs + len(hits), whole + all(hits)
    assert right / runs > 0.96 and whole / len(pages) > 0.8


ARTICLE = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{margin:0}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li><li><a href="/3">More</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this thing now.</div><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>Fish &amp; chips &#38; peas</h1><p><b>The first  paragraph\n of it.<br><p>A second&nbsp;one, with <a href=x>a link</a> in it.</p>
<ul><li>item one is here.<li>item two is there.</ul></article>
<section class="comments"><div class="comment"><p>Great post, thank you.</p></div><div class="comment"><p>I disagree with that.</p></div></section>
<aside><h3>Related</h3><ul><li><a href="/r">Other</a></li></ul></aside><form><label>Mail</label><input></form>
<footer>&copy; Somebody &middot; All rights.</footer>"""


def test_a_page(model):
    assert model.texts([ARTICLE])[0].split("\n\n") == [
        "Fish & chips & peas",
        "The first paragraph of it.",
        "A second one, with a link in it.",
        "item one is here.",
        "item two is there.",
    ]


def test_against_the_article_element(model, sf_dir):
    """The test pages mark their article; the model does not know that element's meaning beforehand."""
    import html
    import re

    import duckdb

    rows = duckdb.sql(f"select html from '{sf_dir}/pages.parquet'").fetchall()
    right = 0
    for (source,), text in zip(rows, model.texts([r[0] for r in rows])):
        inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = [re.sub(r"<[^>]+>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside)]
        right += text == "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
    assert right >= 0.99 * len(rows)


@pytest.mark.parametrize(
    "source",
    ["", "<", "</", "< p>", "<p", "<p title='", "<!--", "<script>", "&#x110000;&#0;", "<<<>>>", "<div>" * 2_000, "</div>" * 50, "\x00<p>\x00"],
)
def test_odd_pages_do_not_raise(model, source):
    assert isinstance(model.texts([source])[0], str)


def test_tags_that_end_others():
    page = Page("<p>a<p>b<div>c</div>d<ul><li>e<li>f</ul>g<table><tr><td>h<td>i</table><b>j</p>k")
    assert [t for t in page.text if t] == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k"] or "jk" in page.text
    assert [page.tag[page.parent[i]] for i, t in enumerate(page.text) if t][:7] == ["p", "p", "div", "html", "li", "li", "html"]


def test_table(spark, model):
    schema = "page_id bigint, url string, html string, text int, n_chars int, doc_id int"
    rows = [(1, "u", ARTICLE, 1, 1, 1), (1, "u", ARTICLE, 1, 1, 1), (2, None, None, 1, 1, 1), (None, "v", "", 1, 1, 1), (3, "w", ARTICLE.replace("item one", "é" * 300_000), 1, 1, 1)]
    found = extraction.extract(spark.createDataFrame(rows, schema).repartition(2), model).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["text"] for r in found if r["page_id"] in (2, None)] == ["", ""]
    assert {r["text"].count("\n\n") for r in found if r["page_id"] in (1, 3)} == {4}
    assert extraction.extract(spark.createDataFrame([], schema), model).count() == 0


ODD = ["<a ", "<a", "<a\"", "<my-x>t ", "<div>", "<b><p>x</p>", "</y>", "<my-x></y>", "<!", "<a '", "<a \"x' ", "<thead>", '<p class="', "<tr><p>", "<h1></h2>", "<x a='b\" "]


@pytest.mark.parametrize("piece", ODD)
def test_odd_pages_take_linear_time(piece):
    """A megabyte of one oddity: seconds, where a search from every tag would take hours."""
    start = time.perf_counter()
    Page(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 5


def _plain_tags(source):
    """Tags and text as the reader takes them, from a search at every place."""
    out, at = [], 0
    for found in iter(lambda: dom.TAG.search(source, at), None):
        out.append((found.start(), found.end(), found[1], found[2]))
        at = found.end()
    return out


PIECES = ["<a ", "<a>", "<!", "<!--", "-->", '"', "'", ">", "<", "x", "=", "<b c='", "</p", "<?", "<![CDATA[", "]]>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_tags_against_search_at_every_place(source):
    page = Page("")
    assert [(f.start(), f.end(), f[1], f[2]) for f in page._tags(source)] == _plain_tags(source)


def _plain_open(source):
    """Parents of blocks by walking down all that is open, for every tag: the rules as they are stated."""
    opened, parents, tags = [("html", 0)], [-1], ["html"]
    block = lambda: next(n for _, n in reversed(opened) if n >= 0)
    for _, _, slash, tag in _plain_tags(source):
        if tag is None or tag == "html":
            continue
        if slash:
            for at in range(len(opened) - 1, 0, -1):
                name = opened[at][0]
                if name == tag or name in dom.HEADINGS and tag in dom.HEADINGS:
                    del opened[at:]
                    break
                if tag in dom.INLINE and opened[at][1] >= 0:
                    break
        elif tag in dom.INLINE:
            if tag not in dom.VOID:
                opened.append((tag, -1))
        else:
            for at in range(len(opened) - 1, 0, -1):
                name = opened[at][0]
                if tag in dom.CLOSED_BY.get(name, ()):
                    del opened[at:]
                    break
                if name in dom.SCOPE:
                    break
            parents.append(block())
            tags.append(tag)
            opened.append((tag, len(tags) - 1))
    return list(zip(tags, parents))


NAMES = "p li ul b a td tr table h1 h2 div my-x option dt dd dl thead tbody section br".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([f"<{n}>" for n in NAMES] + [f"</{n}>" for n in NAMES]), max_size=30).map("".join))
def test_tree_against_walking_down(source):
    page = Page(source)
    assert list(zip(page.tag, page.parent)) == _plain_open(source)


def test_deep_pages(monkeypatch):
    """Messages node by node are those level by level, and deep pages take seconds."""
    model = extraction.default_extractor()
    assert extraction.default_extractor() is model
    pages = [Page(s) for s in extraction.labelled_pages()[:20]]
    forest = extraction.Forest(pages, model.vocabulary)
    unary = forest.unary(model.weights)
    by_level = forest.messages(unary, model.edge)
    monkeypatch.setattr(extraction, "DEEP", 0)
    by_node = forest.messages(unary, model.edge)
    assert np.allclose(by_level[0], by_node[0]) and np.allclose(by_level[1], by_node[1]) and np.isclose(by_level[2], by_node[2])
    monkeypatch.undo()
    for piece in ("<div>t ", "<my-x>t "):
        start = time.perf_counter()
        model.texts([piece * (1_000_000 // len(piece))])
        assert time.perf_counter() - start < 15
