"""What a host's wrapper keeps and drops inside articles and main elements, and its size."""

import json
import random
import time

import pytest

from sparkclust.llm import wrappers


def fold(pages):
    reader, w = wrappers.Pages(), wrappers.Wrapper()
    for p in pages:
        w.align(*reader.blocks(p), reader.paths)
    return reader, w


def texts(pages):
    reader, w = fold(pages)
    rules = json.loads(json.dumps(w.rules()))
    return [wrappers.page_text(reader.blocks(p)[0], reader.paths, rules) for p in pages], [wrappers.page_text(reader.blocks(p)[0], reader.paths, {}) for p in pages]


SIDE = "<div class=sidebar><p>Side {0}</p></div>"
PARTS = [
    ("<article class='post category-social tag-search comments-open'><h1>T{0}</h1><p>Body {0}.</p></article>" + SIDE, "T{0}\nBody {0}."),
    ("<article><div class='entry-header'><h1>Title {0}</h1></div><p>Body {0}.</p></article>", "Title {0}\nBody {0}."),
    ("<article><section class='social-science'><p>On society {0}.</p></section><p>Body {0}.</p></article>", "On society {0}.\nBody {0}."),
    ("<article><p class='disclaimer'>I own {0} shares.</p><p>Body {0}.</p></article>", "I own {0} shares.\nBody {0}."),
    ("<article><p>As <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> shows.</p></article>", "As x={0} shows."),
    ("<main><header><h1>Title {0}</h1></header><p>Body {0}.</p></main>", "Title {0}\nBody {0}."),
]


@pytest.mark.parametrize("page, want", PARTS)
@pytest.mark.parametrize("n", [1, 2, 7])
def test_no_name_drops_text_of_an_article(page, want, n):
    pages = [f"<body><nav>Menu</nav>{page.format(i)}<footer>f</footer></body>" for i in range(n)]
    assert texts(pages)[0] == [want.format(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 4, 5, 12])
def test_templates_go_where_the_wrapper_shows_them(n):
    share = "<div class='share-box'><p>Share this story</p></div>"
    in_article = [f"<article><h1>T{i}</h1><h2>Summary</h2><p>Body {i}.</p>{share}<div id=comments><p>Nice {i}!</p></div><div class='ad'>Buy {i}</div></article>" for i in range(n)]
    got, plain = texts(in_article)
    assert got == [f"T{i}\nSummary\nBody {i}." for i in range(n)] and plain == [f"T{i}\nSummary\nBody {i}.\nShare this story" for i in range(n)]
    box = "<div class=box><p>Always the same words.</p></div>"
    in_main = [f"<main><h1>T{i}</h1><h2>Summary</h2><div><p>Body {i}.</p></div>{box}</main>" for i in range(n)]
    got, plain = texts(in_main)
    assert got == [f"T{i}\nSummary\nBody {i}." for i in range(n)] and all(t.endswith("Always the same words.") for t in plain)
    # a suspect with texts of its own stays
    own = [f"<article><p>Body {i}.</p><div class='related-work'><p>Others found {i}.</p></div></article>" for i in range(n)]
    assert texts(own)[0] == [f"Body {i}.\nOthers found {i}." for i in range(n)]


def test_comments_and_adverts_go_anywhere():
    page = "<article><p>Body.</p><section class='reader-comments'><article class='comment'>Hi</article></section><div class='ad-banner'>x</div><div class='cookie-notice'>y</div></article>"
    assert texts([page])[0] == ["Body."]


def test_names_of_single_pages_are_folded():
    rng = random.Random(1)

    def page(i):
        own = "".join(rng.choice("abcdefgh") for _ in range(12))
        return f"<body class='page-{own}'><div class='k post-{own}' id='{own}'><p class=lead>Lead {i}.</p><p>Story number {i}.</p></div><div class=u><p>Always.</p></div></body>"

    pages = [page(i) for i in range(3000)]
    t0 = time.time()
    reader, whole = fold(pages)
    spent = time.time() - t0
    assert len(whole.nodes) <= wrappers.MAX_NODES and len(json.dumps([whole.nodes, whole.order, whole.known])) < 100_000 and spent < 20
    parts = [fold(pages[k::5])[1] for k in range(5)]
    small = [fold(pages[k * 20 : k * 20 + 20])[1] for k in range(3)]  # too few pages to fold
    for other in [*parts[1:], *small]:
        parts[0].merge(wrappers.Wrapper(*json.loads(json.dumps([other.pages, other.nodes, other.order, other.known]))))
    assert parts[0].pages == 3060 and len(parts[0].nodes) <= wrappers.MAX_NODES
    for w in (whole, parts[0]):
        rules = json.loads(json.dumps(w.rules()))
        fresh = page(9999)
        assert wrappers.page_text(reader.blocks(fresh)[0], reader.paths, rules) == "Lead 9999.\nStory number 9999."


def test_rules_beyond_the_broadcast_are_joined_in_parts(spark, monkeypatch):
    page = "<article><h1>T{0}</h1><p>Body {0}.</p><div class='share-box'><p>Share this</p></div></article>"
    rows = [(i, f"http://h{i % 3}.example/{i}", page.format(i)) for i in range(60)] + [(60, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, wrappers.extract(df).collect()))
    monkeypatch.setattr(wrappers, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wrappers.extract(df).collect())) == want and want[5][-1] == "T5\nBody 5."
