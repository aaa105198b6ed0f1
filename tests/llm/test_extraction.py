import html as entities
import random
import re
import time

import pytest

from plumbline.llm import extraction
from plumbline.llm.dom import parse
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def expected(page):
    """Main text of a driver page, which stands in its one article of headings and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h\d)>", article)
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_driver_pages_are_extracted_whole(spark):
    got = {r.page_id: r for r in QUERIES["op7_gbt_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    right = sum(got[p.page_id].text == expected(p.html) for p in pages)
    assert right == len(pages)
    assert all(got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url for p in pages)


def text_of(trees, page):
    nodes = parse(page)
    return extraction.main_text(nodes, extraction.decode(nodes, trees.probability(extraction.node_features(nodes, trees.tokens))))


def test_held_out_composed_pages(trees):
    rng = random.Random(99)
    words = [" ".join(f"{rng.choice('abcdefg')}{rng.randrange(99)}{rng.choice(['', ',', '.'])}" for _ in range(60)) for _ in range(50)]
    hit = miss = extra = 0
    for _ in range(150):
        page = extraction.compose_page(rng, words)
        nodes = parse(page)
        want = {r for x, y in zip(nodes, extraction._weak_labels(nodes)) if y == 1 for r in x.runs}
        taken = extraction.decode(nodes, trees.probability(extraction.node_features(nodes, trees.tokens)))
        got = {r for x, t in zip(nodes, taken) if t for r in x.runs}
        hit += len(want & got)
        miss += len(want - got)
        extra += len(got - want)
    assert hit / (hit + miss) > 0.93 and hit / (hit + extra) > 0.93


def test_decoding_never_takes_below_a_left_out_block(trees):
    rng = random.Random(3)
    for _ in range(50):
        nodes = parse(extraction.compose_page(rng, ["a b c, d e."]))
        p = [rng.random() for _ in nodes]
        taken = extraction.decode(nodes, extraction.np.array(p))
        kept = [i for i, t in enumerate(taken) if t]
        for i in kept:
            up = nodes[i].parent
            while up > 0 and taken[up]:
                up = nodes[up].parent
            while up > 0:
                assert not taken[up]
                up = nodes[up].parent


def test_parser():
    runs = lambda page: [t for n in parse(page) if not n.hidden for _, t in n.runs]
    assert runs("<p>a &amp; b\n\t c<p><b>d<br>e</b>f<p/>g") == ["a & b c", "d ef", "g"]
    assert runs('<script>var t="</p>";</script><style>x</style><p title="a>b">x</p></p>tail') == ["tail", "x"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "d", "c"]
    assert runs("<!-- <p>no</p> --><p>2 < 3 &eacute;&#33;") == ["2 < 3 é!"]
    assert runs("") == runs(None) == [] and runs("<p>cut <a href='x") == ["cut <a href='x"]


def test_odd_rows(spark, trees):
    long = "<article>" + "<p>some words, here.</p>" * 20000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (None, "<article><p>one two three.</p></article>", "x"), (3, long, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = extraction.extract(df, trees).collect()
    assert [(r.page_id, len(r.text)) for r in out[:3]] == [(1, 0), (2, 0), (3, 20000 * 18 - 1)]
    assert out[3].text == "one two three." and out[4].text == out[2].text
    assert extraction.extract(df.limit(0), trees).count() == 0
    assert extraction.fit(df.limit(0)).roots


@pytest.mark.parametrize("page", [
    '<a b="x ' * 130000, '<a b="x ' * 130000 + ">", "<a b=\"x' " * 100000 + '>"', "<div>" * 40000 + "</p>" * 40000, "<" * 900000, "<!" * 400000,
    "<script>" + "</script " * 90000, "<center>" * 40000 + "<option></option>" * 30000, "<ul>" + "<li>x" * 60000,
])
def test_odd_pages_take_linear_time(page):
    start = time.perf_counter()
    parse(page)
    assert time.perf_counter() - start < 5


P = "Seven of the older houses by the harbour were sold last spring, and the new owners have begun to repair their roofs."
Q = "The council, which had asked for plans in May, agreed to the work on one condition: the fronts have to stay as they are."
R = "Most of the money comes from a fund for old towns; the rest is paid by the owners, who may take ten years for it."
# Written by hand: a page and the blocks of its main text.
HAND = [
    (f"<body><header><h1>Town Post</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><h1>Roofs</h1><p>{P}<p>{Q}<p>{R}</article><footer>Contact us</footer>", ["Roofs", P, Q, R]),
    (f"<div id=top class=navbar><a href=a>One</a> <a href=b>Two</a></div><div class='post-content'><h2>Harbour</h2><p>{P}</p><p>{R}</p></div><div class=sidebar><h3>Popular</h3><ul><li><a href=c>Other story</a></li></ul></div>", ["Harbour", P, R]),
    (f"<main><h1>Plans</h1><p>{Q}</p><blockquote><p>{P}</p></blockquote><ul><li>{R}</li></ul></main><aside class=ad>Buy now</aside><div id=footer>Terms and privacy</div>", ["Plans", Q, P, R]),
    (f"<div class=wrapper><div class=menu><a href=1>Start</a><a href=2>Shop</a></div><div class=article-body><p>{P}</p><div class='share social'><a href=x>Share</a><a href=y>Like</a></div><p>{Q}</p></div><div class=comments><p>Nice one!</p><p>First.</p></div></div>", [P, Q]),
    (f"<article><p>{P}</p><p>The sum is <math><mi>a</mi>+<mi>b</mi></math> in all, as the fund has told the council in its letter.</p><p>{R}</p></article><form><input name=q><button>Search</button></form>", [P, "The sum is", R]),
    (f"<html><body><div class='cookie notice'>We use cookies. <a href=#>Accept</a></div><section class=main-content><h1>Money</h1><p>{R}</p><p>{Q}</p></section><div class='related links'><a href=1>More</a><a href=2>News</a></div>", ["Money", R, Q]),
]


def test_pages_written_by_hand(spark):
    trees = extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HAND)], "page_id int, html string")
    got = {r.page_id: r.text.split("\n") for r in extraction.extract(pages, trees).collect()}
    held = wanted = extra = 0
    for i, (_, blocks) in enumerate(HAND):
        held += sum(any(g.startswith(b) for g in got[i]) for b in blocks)
        wanted += len(blocks)
        extra += sum(not any(g.startswith(b) or g[0] in "ab+" or g.startswith("in all") for b in blocks) for g in got[i] if g)
    assert held >= 0.9 * wanted and extra <= 2, (held, wanted, extra, got)
