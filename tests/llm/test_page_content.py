"""Main text of pages: parsing, exact marginals, the gradient, accuracy on labelled pages that training has not seen."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from tagloom.llm import page_content as C
from tagloom.llm.labelled_pages import labelled_page, labelled_pages
from tagloom.llm.page_tree import parse
from tagloom.llm.queries import op12_tree_model_extract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return C.train(labelled_pages(300, 7), rounds=200)


def blocks(source):
    return [t for t in parse(source).text if t is not None]


def under(source):
    page = parse(source)
    return [(page.tag[page.parent[i]], t) for i, t in enumerate(page.text) if t is not None]


@pytest.mark.parametrize("source, want", [
    ("a <b>b</b>c<br>d", ["a bc", "d"]),
    ("<p>one<p>two<div>three</p>four</div>five", ["one", "two", "three", "four", "five"]),
    ("<script>var t='</p>x';</script>&eacute;&#33;&amp;amp;<style>p{}</style>", ["é!&amp;"]),
    ("x <!-- <p>no</p> --> y<!doctype html><title>t</title>", ["x y"]),
    ("a < b and 3 > 2 <p title='>'>q<p class=\"x", ["a < b and 3 > 2", "q"]),
    ("<SCRIPT>never ended <p>text", []),
    (" \n\t ", []), ("", []), ("&nbsp;a&nbsp;\n b&#8195;c", ["a b c"]),
    ("in<i>li</i>ne<span> text</span> <a href=x>li<b>nk</b></a>.", ["inline text link."]),
])
def test_blocks(source, want):
    assert blocks(source) == want


def test_unclosed_elements_end_where_html_ends_them():
    assert under("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("", "e")]
    assert under("<table><tr><td>a<td>b<tr><td>c</table>") == [("td", "a"), ("td", "b"), ("td", "c")]
    assert under("<div><h1>a<p>b</div>c</section>") == [("h1", "a"), ("p", "b"), ("", "c")]
    page = parse('<div class="siteHeader main-nav" id=top1 role="banner"><a href=x>link</a> text</div>')
    assert page.names[1] == ("site", "header", "main", "nav", "top", "banner") and page.linked[2] == 4


def _random_forest(draw, sizes):
    parent, depth, begins = [], [], []
    for size in sizes:
        begins.append(len(parent))
        for i in range(size):
            up = draw.randrange(i) if i else -1
            parent.append(begins[-1] + up if i else -1)
            depth.append(depth[begins[-1] + up] + 1 if i else 0)
    zero = np.zeros(0, np.int64)
    return C.Forest(np.array(parent), np.array(depth), np.zeros(len(parent), np.int64), zero, zero, np.zeros(len(parent), bool), np.array(begins))


def test_marginals_are_those_of_all_states():
    draw, numbers = random.Random(3), np.random.default_rng(3)
    for sizes in ([1], [2], [7], [5, 1, 6]):
        trees = _random_forest(draw, sizes)
        n = len(trees.parent)
        node, edge = numbers.normal(size=(n, 2)) * 2, numbers.normal(size=(n, 2, 2)) * 2
        held, pairs, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for states in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(node[i, states[i]] for i in range(n)) +
                            sum(edge[i, states[trees.parent[i]], states[i]] for i in range(n) if trees.parent[i] >= 0))
            total += weight
            for i in range(n):
                held[i, states[i]] += weight
                if trees.parent[i] >= 0:
                    pairs[i, states[trees.parent[i]], states[i]] += weight
        got_held, got_pairs, log_sum = C.sum_product(trees, node, edge)
        assert np.allclose(got_held, held / total) and np.allclose(got_pairs, pairs / total) and np.isclose(log_sum, np.log(total))


def test_training_raises_the_likelihood_of_the_labels():
    pages = labelled_pages(12, 50)
    parsed = [parse(p) for p in pages]

    def likelihood(model):
        trees = C.forest(parsed, model.known)
        held = np.concatenate([C.labels(p) for p in parsed]).astype(int)
        score = np.bincount(trees.at, model.weights[trees.feature], len(held))
        inner = np.flatnonzero(trees.parent >= 0)
        own = score[held == 1].sum() + model.edges[trees.kind[inner], held[trees.parent[inner]], held[inner]].sum()
        return own - C.sum_product(trees, np.stack([0 * score, score], axis=1), model.edges[trees.kind])[2]

    values = [likelihood(C.train(pages, rounds=r)) for r in (1, 10, 80)]
    assert values[0] < values[1] < values[2] < 0


def test_accuracy_on_unseen_labelled_pages(model):
    parsed = [parse(p) for p in labelled_pages(150, 90_000)]
    trees = C.forest(parsed, model.known)
    told = np.concatenate([C.labels(p) for p in parsed])[trees.is_text]
    got = (model.marginals(trees) >= 0.5)[trees.is_text]
    assert (told == got).mean() > 0.98


def test_pages_of_other_layouts(model):
    page = ("<div class='cookie'>We use cookies. Accept all.</div><div id='main'><h1>Big news today</h1><p>Something <b>hap</b>pened, they said.</p>"
            "<p>It is good.</p><div class='ad'>Buy our shoes. They are nice.</div><p>More text &eacute;t&eacute;.</p><form><label>Your mail</label>"
            "<button>Send</button></form></div><aside><h3>Related</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></aside>"
            "<section class='comments'><div class='comment'><p>I like this, really. Very much so.</p></div></section><footer>&copy; Site.</footer>")
    assert C.main_texts(model, [page, "", "<nav><a href=x>x</a></nav>"]) == [
        "Big news today Something happened, they said. It is good. More text été.", "", ""]


def test_a_batch_gives_what_its_pages_give(model):
    pages = [labelled_page(n) for n in range(300, 320)]
    assert C.main_texts(model, pages) == [C.main_texts(model, [p])[0] for p in pages]


def test_undecided_blocks_are_kept():
    model = C.ContentModel({}, np.zeros(0), np.zeros((C.EDGE_KINDS, 2, 2)))
    assert C.main_texts(model, ["<nav>a</nav><p>b"]) == ["a b"]


def test_messy_tables(spark, model):
    article = "<nav><a href=x>Menu</a></nav><article><h1>A</h1>" + "<p>Long text, with words.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "<article><p>Deep text, as it is.</p></article>"
    rows = [(1, "u", None, "x", 1), (2, None, "", None, None), (None, "u", article, "y", 2), (1, "u", None, "x", 1), (3, "v", "<p>\x00 </p>", "", 0), (4, "w", deep, "", 0)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in C.extract_main_text(table, labelled=labelled_pages(60, 7)).collect()}
    assert got[1, "u"] == got[2, None] == ("", 0) and got[None, "u"][0].count("Long text, with words.") == 20_000
    assert got[None, "u"][1] == len(got[None, "u"][0]) and len(got) == 5
    empty = spark.createDataFrame([], table.schema)
    assert C.extract_main_text(empty, labelled=labelled_pages(5, 7)).count() == 0


def test_query_takes_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for row in pages.collect():
        inside = re.search("<article>(.*)</article>", row.html, re.S)[1]
        want[row.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
    got = op12_tree_model_extract(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
