"""Wrapper induction with its production settings: whole articles, notices of small and mixed hosts, long lists."""

import random

import pytest

from attestor.llm import wrappers
from attestor.llm.wrappers import Node, read_page


def texts(html):
    return [b[1] for b in read_page(html)[1]]


@pytest.mark.parametrize("html, want", [
    ('<div class="page has-sidebar"><article><h1>T</h1><p>body</article><div class="sidebar">no</div>', ["T", "body"]),
    ('<form action="/x"><article><h1>T</h1><p>body</article><button>no</button></form>', ["T", "body"]),
    ('<article><h1 class="entry-header">T</h1><p>body</article>', ["T", "body"]),
    ('<form><div>Page in a form, as some servers write it</div><input><select><option>no</select></form>', ["Page in a form, as some servers write it"]),
    ('<div>Long text of the page itself.</div><form>Ask us</form>', ["Long text of the page itself."]),
    ('<div id="comments"><article>said</article></div><article>the page</article>', ["the page"]),
    ('<main><header><h1>T</h1></header><div class="comments">no</div><p>x</main><footer>no</footer>', ["T", "x"]),
    ('<div class="search-result-page"><p>a</p></div><div class="Search">no</div>', ["a"]),
    ('<aside><article>only one</article></aside>', ["only one"]),
    (None, []), ("", []), ("<article></article>plain", ["plain"]),
])
def test_candidates(html, want):
    assert texts(html) == want


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return {r.page_id: r.text for r in wrappers.extracted(df).collect()}


def site(host, first, count, notice="Same words on all pages", legal="All rights reserved by the owner of this site."):
    return [
        (first + i, f"http://{host}/{i}", f'<body><div class="top">{notice}</div><div class="text">' + "".join(f"<p>Own text {host} {i}.{k} with some more words in it" for k in range(i % 5 + 1)) + f"</div><div>{legal}</div>")
        for i in range(count)
    ]


def test_notices_without_article_tags(spark):
    rows = site("a.org", 0, 19) + site("b.org", 100, 2) + site("c.org", 200, 57) + site("d.org", 300, 1)
    got = extracted(spark, rows)
    for host, first, count in (("a.org", 0, 19), ("b.org", 100, 2), ("c.org", 200, 57)):
        for i in range(count):
            assert got[first + i].split("\n") == [f"Own text {host} {i}.{k} with some more words in it" for k in range(i % 5 + 1)]
    assert got[300].startswith("Same words on all pages\n")  # one page tells nothing


def test_near_copies_keep_their_text(spark):
    """Two pages that differ in one paragraph are no template; nor are openings shared by a few articles."""
    shared = "".join(f"<p>Paragraph {k} of a text that was copied with one change" for k in range(9))
    rows = [(i, f"http://copy.org/{i}", f"<div>{shared}<p>changed {i}</div>") for i in range(2)]
    rows += [(10 + i, f"http://art.org/{i}", f"<article><p>As every week<p>Story {i}</article>") for i in range(12)]
    got = extracted(spark, rows)
    assert all(got[i].count("\n") == 9 for i in range(2))
    assert all(got[10 + i] == f"As every week\nStory {i}" for i in range(12))


@pytest.mark.parametrize("first, second", [(40, 120), (20, 120), (120, 40), (3000, 2500)])
def test_notice_behind_long_lists_aligns(first, second):
    def page(count, seed):
        rng = random.Random(seed)
        items = "".join(f"<p>{k}</p>" if rng.random() < 0.7 else f"<div><p>{k}</p></div>" for k in range(count))
        return read_page(f"<section>{items}<h2>Notice</h2></section>")[0]

    a, b = page(first, 1), page(second, 2)
    last = [max(n.number for n in wrappers._in_order(t)) for t in (a, b)]
    assert wrappers.align(a, b)[last[0]] == last[1]


def test_halved_tables_match_as_much(monkeypatch):
    def tree(seed):
        rng, root, at = random.Random(seed), Node("r", 0), 0
        for _ in range(60):
            child = Node(rng.choice("abc"), at := at + 1)
            child.children = [Node(rng.choice("xy"), at := at + 1) for _ in range(rng.randint(0, 3))]
            root.children.append(child)
        return root

    a, b = tree(1), tree(2)
    whole = wrappers.align(a, b)
    monkeypatch.setattr(wrappers, "TABLE_CELLS", 10)
    halved = wrappers.align(a, b)
    assert len(whole) == len(halved) and len(set(halved.values())) == len(halved)


def test_deep_trees():
    a, b = (read_page("<div>" * n + "x")[0] for n in (5000, 4000))
    assert len(wrappers.align(a, b)) == 4001
