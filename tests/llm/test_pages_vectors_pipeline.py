"""HTML wrappers, exact top-k and the pipeline."""

import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from helpers import awkward_rows, frame
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparkclust.llm import knn, wrappers

ARTICLE = "<article><h1>Head &amp; <i>tail</i></h1><p>First  para<b>graph</b>\n here.<p>Second &lt;one&gt;<br>goes on.<ul><li>a<li>b</ul></article>"
WANT = "Head & tail\nFirst paragraph here.\nSecond <one> goes on.\na\nb"


@pytest.mark.parametrize(
    "around",
    [
        "<html><head><title>T</title></head><body>{}</body></html>",
        "<body><header><h2>Site</h2></header><nav><ul><li><a>x</a></ul></nav>{}<footer>&copy; x</footer>",
        "<div class='sidebar'><p>Side</p></div>{}<div id=\"comments\"><article class='comment'><p>Nice!</p></article></div>",
        "<div class=\"cookie-notice\">We use cookies</div>{}<form><label>Mail</label><input><button>Go</button></form>",
        "<script>var t='</p><article>';</script><style>p{{}}</style><!-- <article> -->{}<aside>More</aside><div class=ad>Buy</div>",
        "<main><div class='content with-sidebar'>{}</div><section class='reader-comments'>No!</section></main>",
    ],
)
def test_the_article_and_nothing_else(around):
    reader = wrappers.Pages()
    blocks, _ = reader.blocks(around.format(ARTICLE))
    assert wrappers.page_text(blocks, reader.paths, {}) == WANT


def fold(pages):
    reader, w = wrappers.Pages(), wrappers.Wrapper()
    for p in pages:
        w.align(*reader.blocks(p), reader.paths)
    return reader, w


def test_wrapper_has_optionals_repeats_and_slots():
    pages = [f"<body><div class=x><h2>Title {i}</h2>{'<p class=lead>lead</p>' if i % 2 else ''}{'<p>text ' * (i % 3 + 1)}{i}</div></body>" for i in range(8)]
    _, w = fold(pages)
    assert w.regex() == "<body> <div.x> <h2> #text </h2> (<p> #text </p> )+ (<p.lead> #same </p.lead> )? </div.x> </body>"


def test_parts_of_a_host_merge_like_the_whole():
    pages = [f"<body><div class=x><p>a{i}</p>{'<p>b</p>' * (i % 2)}</div><div class=y>same</div></body>" for i in range(9)]
    _, whole = fold(pages)
    parts = [fold(pages[k::3])[1] for k in range(3)]
    for other in parts[1:]:
        parts[0].merge(other)
    assert parts[0].pages == whole.pages
    shown = [{p: [*n[:3], n[3] == -1, *n[4:]] for p, n in w.nodes.items()} for w in (whole, parts[0])]
    assert shown[0] == shown[1]


def test_hosts_without_an_article_and_template_texts(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<body><div class=k><p>Story {i} begins.</p><p>It goes {i} on.</p></div><div class=u><p>Always the same.</p></div><div class=l><a>link {i}</a></div></body>")
        for i in range(12)
    ]
    rows += [(100 + i, "http://copies.example/x", "<article><h1>Twin</h1><p>Same text.</p></article>") for i in range(9)]
    rows += [(200 + i, f"https://u@t.example:80/{i}", f"<article><p class=share9x>Read this next</p><p>Own {i}</p></article>") for i in range(9)]
    rows += [(300, None, None), (301, "::odd", ""), (302, None, "<p>Only &amp; text"), (303, "http://z/", "a < b <"), (304, "http://z/", "<p>x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "row": F.lit(1), "host": F.lit(2), "rules": F.lit(3)})
    out = wrappers.extract(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert all(got[i] == f"Story {i} begins.\nIt goes {i} on." for i in range(12))
    assert all(got[100 + i] == "Twin\nSame text." for i in range(9))
    assert all(got[200 + i] == f"Own {i}" for i in range(9))
    assert (got[300], got[301], got[302]) == ("", "", "Only & text") and got[304] == "\n".join(["x"] * 50_000)
    assert set(out.columns) == set(df.columns)
    assert wrappers.extract(df.where("false")).count() == 0


def test_children_are_aligned_in_order():
    def shown(*pages):
        one, (_, whole) = [fold([p])[1] for p in pages], fold(pages)
        for other in one[1:]:
            one[0].merge(other)
        assert one[0].expression() == whole.expression()
        return whole.expression()

    assert shown("<div><h2>A</h2><p>x</div>", "<div><h2>B</h2><ul></ul><p>y<p>z</div>") == "<div> <h2> #text </h2> (<ul> </ul> )? (<p> #text </p> )+ </div>"
    assert shown("<div><h2>A</h2><p>x<ol></ol></div>", "<div><p>x<h2>A</h2><ol></ol></div>") == "<div> ( (<h2> #same </h2> )? (<p> #same </p> )? )* <ol> </ol> </div>"
    assert shown("<div><p>x<ul></ul><p>y</div>", "<div><p>x<ol></ol></div>") == "<div> ( (<p> #text </p> )? (<ul> </ul> )? )* (<ol> </ol> )? </div>"


def test_merged_models_have_every_name_once():
    rng = random.Random(1)
    for _ in range(300):
        model, names = [], set()
        for _ in range(6):
            page = [rng.choice("abcdefg") for _ in range(rng.randint(0, 6))]
            names |= set(page)
            model = wrappers.merge_groups(model, wrappers.page_groups(page))
            assert sorted(n for g, _ in model for n in g) == sorted(names)
            place = {n: k for k, (g, _) in enumerate(model) for n in g}
            assert all(place[a] < place[b] or (place[a] == place[b] and model[place[a]][1]) for a, b in zip(page, page[1:]))


def test_slots_decide_before_names(spark):
    page = "<body><div class=content>Our terms.</div><div class=k><p>Long story number {0}.</p></div><div class=m><p>Break.</p></div><div class=k9><p>End {0}.</p></div><div class=z><p>Last.</p></div></body>"
    rows = [(i, "http://h.example/", page.format(i)) for i in range(8)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {i: f"Long story number {i}.\nBreak.\nEnd {i}." for i in range(8)}


def test_no_text_of_an_article_is_a_template(spark):
    def story(k):
        return f"<article><h1>Title {k}</h1><h2>Summary</h2><p>Own {k}</p></article>"

    quoted = "<article><h1>Hit</h1><blockquote>Quoted once.</blockquote><p>Body</p></article>"
    rows = [(i, "http://copied.example/a", quoted if i < 9 else story(i)) for i in range(12)]
    rows += [(100 + i, "http://four.example/", story(i)) for i in range(4)] + [(200 + i, "http://five.example/", story(i)) for i in range(5)]
    spread = "<div class=u><p>Same.</p></div><div class=lead><p>Lead {0}</p></div><div class=k><h2>Summary</h2><p>Long story number {0}.</p></div><div class=l><a>link {0}</a></div>"
    rows += [(300 + i, "http://spread.example/", f"<body>{spread.format(i)}</body>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(9)} == {"Hit\nQuoted once.\nBody"}
    assert all(got[b + i] == f"Title {i}\nSummary\nOwn {i}" for b, n in ((100, 4), (200, 5)) for i in range(n))
    assert all(got[300 + i] == f"Lead {i}\nSummary\nLong story number {i}." for i in range(8))


def test_pages_against_their_articles(spark):
    for r in wrappers.op5_wrappers(spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def brute_top(rows, k):
    vec = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for i, q in vec:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in vec if j != i and len(x) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("chunk_rows", [16, 2048])
def test_top_k_with_ties_clusters_and_bad_vectors(spark, chunk_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # equal vectors: ties go to the smaller id
    rows += [(2000, None), (2010, []), (2020, [1.0] * 7 + [None]), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2050, [1.0, 2.0]), (2051, [3.0, 4.0])]  # another width
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"q": F.lit(1), "row": F.lit(2), "width": F.lit(3)})
    got = knn.top_k(df, F.col("vec_id") % 10 == 0, chunk_rows=chunk_rows)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 10)
    assert knn.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("copies", [2, 20])
def test_top_k_of_a_repeated_query(spark, copies, monkeypatch):
    kinds = [[4.0, 0.0], [2.0, 0.0], [1.0, 0.0], [-1.0, 3.0]]
    rows = [(0, kinds[0])] * copies + [(i, kinds[0]) for i in range(1, 9)] + [(11, kinds[1])]
    rows += [(i, kinds[2]) for i in range(12, 20)] + [(i, kinds[3]) for i in range(20, 32)] + [(40, [0.0, 0.0])]
    monkeypatch.setattr(knn, "pick_pivots", lambda *_: {2: 1024 * np.array(kinds)})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 10 == 0, chunk_rows=16).collect())
    vec = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows]
    want = Counter()
    for i, q in vec:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in vec if j != i)[:10]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    assert got == want


def test_numbers_beyond_exact_floats(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0).collect()} == brute_top(rows, 10)


def test_scores_beyond_a_long_saturate(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [1e13, 0.0]), (4, [0.0, 1e36]), (5, [0.0, 0.5]), (10, [3.4e38, -3.4e38]), (6, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    whole = {i: [int(np.floor(min(2.0**100, max(-(2.0**100), 1024 * float(np.float32(c)))))) for c in v] for i, v in rows}
    want = set()
    for i in (0, 10):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], v)))), j) for j, v in whole.items() if j != i)
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    assert got == want


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "mix_sources", "pack_sequences"]
    rows = awkward_rows()
    docs = frame(spark, rows, clash=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_SMALL)
        assert sorted(after.columns) == sorted(docs.columns), name
        docs = after.checkpoint()
    left = {r["doc_id"] for r in docs.collect()}
    assert left and left <= {r[0] for r in rows} and not left & {1, 2, 3, 4, 6, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= len(left)


def test_pipeline_run_on_a_table(spark):
    out = entry.queries()["pipeline"](spark, SF_SMALL).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert not any(labels.get(i) == 0 for i in out["doc_id"].unique())
