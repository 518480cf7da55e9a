"""Blocks of pages, the choice among them, and main text against the pages' own markup."""

import itertools
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlag.llm import html_extraction as hx
from flightlag.llm.dom import Blocks, blocks_of, parse
from flightlag.llm.layouts import MARK, layout, marked_labels, parts_of, silver_labels
from tests.llm import brute


def plain_article(html: str) -> str:
    """What stands between the article's tags, a block a line, by string operations."""
    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    lines = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(line for line in lines if line)


@pytest.fixture(scope="module")
def judge(spark, sf_dir):
    return hx.fit(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet"))


def test_every_page_of_the_table(spark, sf_dir):
    rows = hx.op13_html_extraction(spark, sf_dir).collect()
    want = Counter()
    for p in brute.table(sf_dir, "pages"):
        text = plain_article(p["html"])
        want[p["page_id"], p["url"], text, len(text)] += 1
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows) == want


def test_awkward_pages(spark, awkward_dir, judge):
    pages = spark.read.parquet(f"{awkward_dir}/pages.parquet")
    found = {r["html"]: r["text"] for r in hx.extract(pages, judge).collect()}
    assert found[None] == "" and found[""] == "" and found["<p>"] == ""
    page = "<article><p>Main text of a page, with a sentence.</p></article><footer>&copy; foot</footer>"
    assert found[page] == "Main text of a page, with a sentence."
    long = next(h for h in found if h and len(h) > 100_000)
    assert found[long] == "\n".join(["one two three & four"] * 20_000)
    assert hx.op13_html_extraction(spark, awkward_dir).count() == pages.count()


def test_empty_table(spark, empty_dir):
    assert hx.op13_html_extraction(spark, empty_dir).collect() == []


def test_layouts_not_learned_from(sf_dir, judge):
    """Side columns, notices, forms and comments go, in layouts drawn from other pages and seeds."""
    pages, labels = [], []
    for p in brute.table(sf_dir, "pages")[:100]:
        page = parse(p["html"])
        parts = parts_of(page, silver_labels(page))
        for k in range(3):
            pages.append(parse(layout(parts, 10**9 + 10 * p["page_id"] + k), MARK))
            labels.append(marked_labels(pages[-1]))
    hit = wrong = missed = 0
    for page, main, text in zip(pages, labels, hx.main_texts(pages, judge)):
        want, got = Counter(t for b, t in page.runs if main[b]), Counter(text.split("\n") if text else [])
        hit += (want & got).total()
        wrong += (got - want).total()
        missed += (want - got).total()
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.95


def test_pages_without_an_article_are_read_by_role(spark):
    page = '<div class="menu">Home</div><div><p>Some text.</p></div><div id="comments"><p>Nice!</p></div>'
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    judge = hx.fit(pages)
    assert isinstance(judge, hx.RoleJudge)
    assert hx.extract(pages, judge).first()["text"] == "Some text."


def test_other_columns_stay(spark, judge):
    page = "<article><p>Some text, and more of it.</p></article>"
    pages = spark.createDataFrame([(page, "old", 1, 2)], "html string, text string, found long, n_chars long")
    row = hx.extract(pages, judge).first()
    assert (row["text"], row["found"], row["n_chars"]) == ("Some text, and more of it.", 1, 2)


# -------------------------------------------------------------------- parsing


def outline(html):
    page = parse(html)
    return [(page.tag[b], t) for b, t in page.runs]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", [("p", "a"), ("p", "b")]),
        ("<p><b>a.<br><p>b</p>", [("p", "a."), ("p", "b")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
        ("<table><tr><td>x<td><p>y<tr><td>z</table>w", [("td", "x"), ("p", "y"), ("td", "z"), ("body", "w")]),
        ("a<!-- <p> -->b<!---->c", [("body", "abc")]),
        ('<script>var t="</p>";</script>a<style>p{}</style>', [("body", "a")]),
        ("<head><title>T</title></head><body>a", [("body", "a")]),
        ("<head><title>T</title><body>a", [("body", "a")]),
        ("1 < 2 &lt; 3 &amp<b>&am</b>", [("body", "1 < 2 < 3 &&am")]),
        ("<p title='a>b' x=\"</p>\" y=it's>c", [("p", "c")]),
        ("a<p class='never ends>b</p>", [("body", "a")]),
        ("<h1>a<h2>b</h1>c", [("h1", "a"), ("h2", "b"), ("body", "c")]),
        ("a</div></p>b", [("body", "ab")]),
        ("x<select><option>no</select><button>no</button><textarea><p>no</textarea>y", [("body", "xy")]),
    ],
)
def test_parse(html, want):
    assert outline(html) == want


def test_link_share_of_a_menu():
    page = parse("<ul><li><a href=x>one</a><li><a href=y>two</ul><p>text</p>")
    share = blocks_of([page]).features[:, 3]
    assert share[page.tag.index("ul")] > 0.8 and share[page.tag.index("p")] == 0


# ------------------------------------------------------------------- decoding


def all_choices(parent):
    """Choices of all blocks in which none contradicts the one around it."""
    for choice in itertools.product(range(3), repeat=len(parent)):
        fits = True
        for i, p in enumerate(parent):
            if p >= 0 and choice[p] == hx.DROP:
                fits &= choice[i] == hx.DROP
            elif p >= 0 and choice[p] == hx.MAIN:
                fits &= choice[i] != hx.AROUND
        if fits:
            yield choice


@pytest.mark.parametrize("seed", range(12))
def test_decode_takes_the_likeliest_consistent_choice(seed):
    rnd = np.random.default_rng(seed)
    parent = np.array([-1] + [int(rnd.integers(0, i)) for i in range(1, 8)])
    depth = np.zeros(8, np.int64)
    for i in range(1, 8):
        depth[i] = depth[parent[i]] + 1
    scores = np.log(rnd.dirichlet([1, 1, 1], 8))
    found = hx.decode(Blocks(np.array([0, 8]), parent, depth, np.zeros((8, 0))), scores)
    assert tuple(found) in set(all_choices(parent))
    best = max(sum(scores[i, c] for i, c in enumerate(choice)) for choice in all_choices(parent))
    assert np.isclose(sum(scores[i, c] for i, c in enumerate(found)), best)
