"""Wrapper induction: the alignment against a brute-force one, what templates change, and edge cases."""

import random

import pytest

from veiljoin.llm import html_extract as h

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows, PAGES), **more).collect()}


def brute(a, b, i, j):
    """Simple tree matching as a plain recursion."""
    if a.label[i] != b.label[j]:
        return 0
    x, y = a.children[i], b.children[j]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x)):
        for q in range(len(y)):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + brute(a, b, x[p], y[q]))
    return h.MATCH + h.EQUAL * (a.text[i] == b.text[j]) + best[-1][-1]


def test_matching_equals_brute_force():
    draw = random.Random(1)

    def source(depth, wide):
        tags = [draw.choice(["div", "section", "ul"]) for _ in range(draw.randint(0, wide))]
        return "".join(f"<{t}>{draw.choice('abc') if draw.random() < 0.7 else ''}{source(depth - 1, wide)}</{t}>" for t in tags) if depth else ""

    for k in range(150):
        a, b = (h.Tree(h.Page(source(*((3, 4) if k % 3 else (1, 40))))) for _ in range(2))
        match = h.Matching(a, b)
        found = match.pairs()
        assert match.value(0, 0) == brute(a, b, 0, 0) == sum(h.MATCH + h.EQUAL * (a.text[i] == b.text[j]) for i, j in found.items())
        assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("count", [2, 400])
def test_templates_change_the_text(spark, count):
    """Without their templates these pages would give menus and notices; with and without a shuffle of the pages."""
    page = lambda i: f"<body><div><span>Home</span> About</div><div class=x>Story {i} of the day</div><div>Terms apply</div>{'<p>More ' + str(i) if i % 3 else ''}"
    rows = [(i, f"http://{'ab'[i % 2]}.com/{i}", page(i)) for i in range(2 * count)]
    assert h.main_text(page(1)) == "Home About Story 1 of the day Terms apply More 1"
    want = {i: f"Home About Story {i} of the day Terms apply" if count == 2 else f"Story {i} of the day" for i, _, _ in rows}
    want = {i: t + (f" More {i}" if i % 3 else "") for i, t in want.items()}
    assert texts(spark, rows) == want
    if count > 2:
        assert texts(spark, rows, broadcast_bytes=-1) == want


def test_probes(spark):
    deep = "<body>" + "<div>" * 210 + "<nav>menu</nav>Own<nav>menu</nav>words"
    assert h.main_text(deep) == "Own words"
    assert h.main_text('<article><p>one <svg class="i"/> two</p><p>three</p></article>') == "one two three"
    assert h.main_text('<main class="content no-sidebar"><p>Body</p></main>') == "Body"
    assert h.main_text('<div class="pull ad-free">a</div><div data-id="share">b</div><div grid="ad">c</div>') == "a b c"
    assert h.main_text("<div id=post>A story that is long</div><article class=teaser>Teaser</article>") == "A story that is long Teaser"
    assert h.main_text("<p>a<span class=ad>x<span>y</span>z</span>b</p><p>c") == "ab c"
    assert h.main_text("<head><title>t</title><body><p>c") == "c"
    again = [(i, "http://a.com/", f"<body><div>May {i}</div><div id=post><h1>Title words</h1><p>One reposted article</p></div>") for i in range(4)]
    assert texts(spark, again)[2] == "May 2 Title words One reposted article"


def test_long_lists_of_children():
    sources = ["<body>" + "".join(f"<{x}>{x}{i}</{x}><{y}>{y}{i}</{y}>" for i in range(2000)) for x, y in (("h2", "p"), ("p", "h2"))]
    a, b = (h.Tree(h.Page(s)) for s in sources)
    match = h.Matching(a, b)
    found = match.pairs()
    assert len(found) >= 4000 and sorted(found.values()) == list(found[k] for k in sorted(found))


def test_long_lists_of_items_with_differing_texts(monkeypatch):
    """Weights are found by kind, not for each pair of items, whether or not the rows of weights are remembered."""
    def source(name, count):
        return "<body>" + "".join(f"<div><p>{name} {i}</p><ul><li>Reply</li>{'<li>Own</li>' if i % 3 else ''}</ul></div>" for i in range(count))

    for cells in (h.ROW_CELLS, 1):
        monkeypatch.setattr(h, "ROW_CELLS", cells)
        a, b = (h.Tree(h.Page(source(*x))) for x in (("one", 30), ("two", 33)))
        match = h.Matching(a, b)
        assert match.value(0, 0) == brute(a, b, 0, 0) == sum(h.MATCH + h.EQUAL * (a.text[i] == b.text[j]) for i, j in match.pairs().items())
    monkeypatch.undo()
    a, b = (h.Tree(h.Page(source(*x))) for x in (("one", 3000), ("two", 3100)))
    match = h.Matching(a, b)
    assert len(match.pairs()) >= 4 * 3000 and len(match.known) < 20


def test_edges(spark):
    long = "<article>" + "<p>words and more</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.com", long), (1, "http://a.com", long), (None, "http://a.com", "<p>x"), (2, None, "<p>y"), (3, "http://b.com", None), (4, "http://b.com", "")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], f"{PAGES}, host string, value string")
    got = sorted(((r.page_id, r.text) for r in h.extract_text(df).collect()), key=str)
    body = " ".join(["words and more"] * 20_000)
    assert got == sorted([(1, body), (1, body), (None, "x"), (2, "y"), (3, ""), (4, "")], key=str)
    assert h.extract_text(df.limit(0)).count() == 0
    ids = df.withColumn("page_id", df.url)
    assert h.extract_text(ids).filter("page_id = 'http://b.com'").count() == 2


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p class="a"">Hello</p><p class="b">World</p></article>', "Hello World"),
        ("<p title=don't>First</p><p>it's here</p><p>Third</p>", "First it's here Third"),
        ("<article><p title=\"a > b\">One</p><p title='c > d' data-x = \"e>\">Two</p><p \"odd\">Three</p><p x=>Four</p></article>", "One Two Three Four"),
        ("<article><p>One</p><noscript class=\"x\"\">no</noscript><p>Two</p></article>", "One Two"),
    ],
)
def test_quotes_open_values_only_after_an_equals_sign(page, text):
    assert h.main_text(f"<body>{page}</body>") == text


@pytest.mark.parametrize("token", "comment-body comment-list reader-comments post-comments-area respond share-buttons related-posts ad-slot promo-box navbar-top ad_300x250 site-nav".split())
def test_blocks_of_comments_and_adverts_go_by_compound_names(token):
    for name in ("class", "id"):
        assert h.main_text(f'<body><article><p>Own words of the article</p><div {name}="{token}"><p>Not own</p></div></article></body>') == "Own words of the article"
        assert h.main_text(f'<body><p>Own words of the page</p><div {name}="x {token}"><p>Not own</p></div></body>') == "Own words of the page"


@pytest.mark.parametrize("token", "has-sidebar comments-open nav-fixed no-banner share-price content".split())
def test_names_of_states_say_nothing(token):
    assert h.main_text(f'<body><article><h1>Head of it all</h1><p class="{token}">Own</p></article></body>') == "Head of it all Own"
