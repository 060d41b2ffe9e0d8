"""Extraction: the tree, the boosted trees and the decoding."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from flowquarry.llm import html_extract as m

SF = "/root/testdata/sf0.01"


def main_text(source):
    """Of the pages of the test tables, whose article is one element."""
    inner = re.search(r"<article>(.*)</article>", source or "", re.S)
    bare = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner[1]) if inner else ""
    return re.sub(r"\s+", " ", html.unescape(bare.replace("<b>", "").replace("</b>", ""))).strip()


def test_parser_repairs():
    page = "<p>one<p>two<b>x</b><ul><li>a<li>b</ul></div>tail<script>var a='</p><p>no';</script><!-- <p>no --> &lt;&amp;&nbsp;z<textarea>no</textarea><td"
    root, runs = m.parse(page)
    assert m.joined(runs, np.ones(len(m.walk(root)), bool)) == "one twox a b tail <& z <td"
    assert [n.tag for n in m.walk(root)] == ["#root", "p", "p", "ul", "li", "li"]
    for odd in ("", "<", "<p", "</p>", "<!--", "<script>", "<a<b>", "&#0;&bogus;"):
        m.parse(odd)


def test_decoding_has_no_contradictions():
    rng = random.Random(1)
    for _ in range(50):
        nodes = [m.Node("#root", None, frozenset())]
        for _ in range(30):
            nodes.append(m.Node("div", rng.choice(nodes), frozenset()))
        nodes = m.walk(nodes[0])
        kept = m.decode(nodes, np.array([rng.uniform(-3, 3) for _ in nodes]))
        assert all(not kept[n.order] or kept[n.parent.order] for n in nodes if n.parent)


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = m.Boosted(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_held_out_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.collect()
    x, y = m.training_rows([r.html for r in rows[:150] if r.html])
    model = m.Boosted(x, y)
    rng = random.Random(4)
    right = furnished = 0
    for r in rows[150:]:
        right += m.extract_page(r.html or "", model) == main_text(r.html)
        furnished += m.extract_page(m.furnished(r.html or "", rows[0].html, rng), model) == main_text(r.html)
    assert right >= 0.98 * len(rows[150:]) and furnished >= 0.95 * len(rows[150:])


def test_query_and_odd_rows(spark):
    want = {r.page_id: main_text(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = m.op4_html_extract(spark, SF).collect()
    assert len(got) == len(want) and sum(r.text == want[r.page_id] for r in got) >= 0.98 * len(want)
    assert all(r.n_chars == len(r.text) for r in got)
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>" + "long text here " * 20000 + "</p></article>"), (2, "u", "plain words")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    assert m.extract(df, m.train(df)).count() == 4 and m.extract(df.limit(0), m.train(df.limit(0))).count() == 0
    assert {r.text for r in m.extract(df, None).collect()} >= {"", ("long text here " * 20000).strip()}


WORDS = "Body text of a page with some words in it, and a few more of them."
LINKS = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6))
ORDINARY = [
    (f"<html><body><article><h1>Title</h1><p>{WORDS}</p></article></body></html>", f"Title {WORDS}"),
    (f"<html><body><article><h1>T</h1><p>{WORDS}</p></article><article><h1>U</h1><p>{WORDS}</p></article></body></html>", f"T {WORDS} U {WORDS}"),
    (f'<html><body><div id="content"><p>{WORDS}</p><p>{WORDS}</p></div></body></html>', f"{WORDS} {WORDS}"),
    (f"<html><body><nav><a href=/>Home</a></nav><div><p>{WORDS}</p><p>{WORDS}</p></div><footer>&copy; x 2020</footer></body></html>", f"{WORDS} {WORDS}"),
    (f"<html><body><nav><a href=/>Home</a> <a href=/c>C</a></nav>{WORDS}<br><br>{WORDS}<footer>&copy; x</footer></body></html>", f"{WORDS} {WORDS}"),
    ("plain words", "plain words"),
    (WORDS * 20, WORDS * 20),
    (f"<html><body><nav><ul>{LINKS}</ul></nav><footer>&copy; x</footer></body></html>", ""),
    (
        f'<body class="home sidebar-right"><div class="cookie-notice"><p>We use cookies. Accept?</p></div><main><h1>T</h1><p>{WORDS}</p></main><div class="comments"><p>nice post</p></div></body>',
        f"T {WORDS}",
    ),
    (f'<div id="x1"><ul>{LINKS}</ul></div><div class="wrap"><h1>T</h1><p>{WORDS}</p><p>{WORDS}</p><ul><li>See <a href=/>this</a> for more</li></ul></div>', f"T {WORDS} {WORDS} See this for more"),
    (f"<article><p title='it's'>{WORDS}</p><p>{WORDS}</p></article>", f"{WORDS} {WORDS}"),
    (f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>{WORDS} <svg><path d='M0'/><text>axis</text></svg></p></article>", f"{WORDS} x=1 {WORDS} axis"),
    (
        f"<nav><ul>{LINKS}</ul></nav><article><h1>T</h1><p>{WORDS}</p><ul><li>one</li><li>two words</li></ul><blockquote><p>Quoted.</p></blockquote>"
        f"<table><tr><th>a</th><td>b c</td></tr></table><pre>x  = 1</pre><p>{WORDS}</p></article><footer>f</footer>",
        f"T {WORDS} one two words Quoted. a b c x = 1 {WORDS}",
    ),
]


@pytest.fixture(scope="module")
def taught_model(spark):
    return m.train(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("source,text", ORDINARY)
def test_ordinary_pages(taught_model, source, text):
    assert m.extract_page(source, taught_model) == text


def test_other_blocks_inside_the_article(spark, taught_model):
    rng = random.Random(8)
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html]
    right = 0
    for page in pages[:100]:
        page = m.enriched(page, rng)
        start, end = page.find("<article>"), page.find("</article>")
        inner = re.sub(r"<(?!/?(?:b|a)\b)[^>]*>", " ", page[start:end])
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", inner))).strip()
        right += m.extract_page(page, taught_model) == want
    assert right >= 98


def test_loose_text_is_a_block():
    nodes, runs = m.page_of("one <i>two</i><br>three<br><br>four<div>five</div>six")
    assert [(n.tag, n.text) for n in nodes] == [("#root", 0), ("#text", 11), ("#text", 4), ("div", 4), ("#text", 3)]
    assert m.joined(runs, np.ones(len(nodes), bool)) == "one two three four five six"


@pytest.mark.parametrize("part", ['<a href="x', '<a href="x>', "<a =\'\">", "<select>", "<!", "</", "<p><i a=", "<div></b1>"])
def test_broken_markup_takes_linear_time(part):
    started = time.time()
    m.page_of(part * 40_001)
    assert time.time() - started < 5


def test_unended_quotes_and_tags():
    for source, text in (('<p>a <b title="x>b</b> c</p>', "a b c"), ('<p>a <b title="x', 'a <b title="x')):
        nodes, runs = m.page_of(source)
        assert m.joined(runs, np.ones(len(nodes), bool)) == text


def test_decoding_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(30):
        nodes = [m.Node("#root", None, frozenset())]
        for _ in range(8):
            nodes.append(m.Node("div", rng.choice(nodes), frozenset()))
        nodes = m.walk(nodes[0])
        odds = np.array([rng.uniform(-3, 3) for _ in nodes])
        own = np.zeros(len(nodes))
        for i, n in enumerate(nodes[1:], 1):
            own[i] = odds[i] + m.PASSED_ON * min(max(own[n.parent.order], -m.CERTAIN), m.CERTAIN)
        best = 0.0
        for choice in itertools.product((False, True), repeat=len(nodes)):
            if all(not choice[n.order] or choice[n.parent.order] for n in nodes[1:]):
                best = max(best, sum(own[i] for i, c in enumerate(choice) if c))
        kept = m.decode(nodes, odds)
        assert abs(own[kept].sum() - best) < 1e-9
