"""Pages, vectors, the pipeline and the registry."""

import html
import math
import random
import re
import time
from collections import Counter

import numpy as np

from ledgerlark.llm import html_extract, pivot_topk

SF = "/root/testdata/sf0.001"


def test_time_grows_with_the_page():
    for piece, n in (("<div>", 200_000), ("<div ", 200_000), ("<div>x ", 100_000), ("<b><div>x</b>", 60_000), ('<a title="x>y ', 60_000), ("<div><tr>x</tr>", 50_000), ("<", 500_000), ("<!--", 200_000)):
        begin = time.perf_counter()
        html_extract.features(html_extract.blocks(piece * n, {}))
        assert time.perf_counter() - begin < 10, piece


def test_markup_is_no_text():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts('<p><a title="x>y">k</a> z') == ["k z"] and texts('<a title="x>y</a> z') == ["y z"]
    assert texts("<p>1 < 2 &amp; &lt;b&gt;</p>a<br>b<wbr>c<hr>d") == ["1 < 2 & <b>", "a bc", "d"]
    assert texts("<math><mi>x</mi></math><svg><text>in</text></svg> <noscript>ns</noscript><textarea>a <b> c</textarea>") == ["xin ns a <b> c"] or texts("<textarea>a <b> c</textarea>") == ["a <b> c"]
    assert texts("a<script>if (x<y) '</p>'</script>b<style>p{}</style>c<!-- <p> -->d</>e<?x y?>f") == ["a b cdef"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"] and texts("<p>x<scr") == ["x"]


def test_held_out_pages(spark):
    model = html_extract.train_extractor(html_extract.labelled_pages(spark))
    rows = html_extract.labelled_pages(spark, 200, seed=99).collect()
    want = ["\n".join(re.sub(r"\s+", " ", m).strip() for m in x.main) for x in rows]
    got = html_extract.main_texts(model, [x.html for x in rows])
    assert sum(a == b for a, b in zip(got, want)) / len(rows) > 0.95


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for x in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", x.html, re.S)[1]
        cut = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert x.text == "\n".join(filter(None, cut)) and x.n_chars == len(x.text)


def test_odd_pages(spark):
    rows = [(1, None, None, "k"), (2, "u", "", "k"), (3, "u", "<article><p>" + "long text " * 50_000 + "</p></article>", "k"), (None, "u", "<b", "k"), (4, "u", "<article><h1>a &amp; b</h1><p>one\n  two<script>x</script> three</article>", "k"), (4, "u", "<article><h1>a &amp; b</h1><p>one\n  two<script>x</script> three</article>", "k")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = {x.page_id: x.text for x in got}
    assert len(got) == 6 and text[1] == text[2] == "" and text[4] == "a & b\none two three" and len(text[3]) == 499_999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in r.normal(size=8)]) for i in range(700)]
    vectors += [(700, vectors[3][1]), (701, vectors[3][1]), (800, None), (900, [1.0, None] * 4), (1000, [float("nan")] * 8), (1100, [float("inf")] * 8), (1200, [1.0]), (1201, [2.0]), (None, vectors[0][1])]
    got = pivot_topk.top_k(spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, score int, id int"), lambda i: i % 100 == 0)
    x = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in vectors if i is not None and i < 800}
    found = {}
    for row in got.collect():
        found.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert found.pop(1200) == {1: (1201, 2048 * 1024)}  # it meets what has its own length
    assert set(found) == {i for i in x if i % 100 == 0}
    for q, rows in found.items():
        want = sorted(((-int(x[q] @ v), i) for i, v in x.items() if i != q))[:10]
        assert [rows[k + 1] for k in range(10)] == [(i, -s) for s, i in want]
    few = pivot_topk.top_k(spark.createDataFrame(vectors[:4], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0)
    assert few.count() == 3
    assert pivot_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).count() == 0


def test_top_k_sends_few_pairs_of_clustered_data(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 12)) * 4
    x = centres[r.integers(0, 30, 9000)] + r.normal(size=(9000, 12)) * 0.05
    told = {}
    got = pivot_topk.top_k(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, report=told).collect()
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 9000, 100):
        scores = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [(y.vec_id, y.score) for y in sorted((y for y in got if y.query_id == q), key=lambda y: y["rank"])] == [(i, -s) for s, i in want]
    assert told["blocks"] > 8 and told["pairs"] < 0.6 * told["all_pairs"] and told["evaluated"] < 0.3 * 90 * 9000


def test_top_k_of_huge_components_and_hot_rows(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [2e17, 0.0]), (3, [-1e17, 5.0]), (100, [1e300, 1e300]), (101, [1e308, -1e308]), (200, [3.0, 4.0])] + [(4, [1.0, 1.0])] * 300
    got, largest = {}, 1.7976931348623157e308
    for y in pivot_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect():
        got.setdefault(y.query_id, []).append((y["rank"], y.vec_id, y.score))
    whole = [(i, [int(max(-largest, min(largest, c * 1024))) for c in v]) for i, v in rows]
    as_double = lambda s: float(s) if abs(s) < 2**1023 else (math.inf if s > 0 else -math.inf)
    for q in (0, 100, 200):
        vec = dict(whole)[q]
        scores = [(sum(a * b for a, b in zip(vec, v)), i) for i, v in whole if i != q]
        want = sorted((-as_double(s), i, max(-(2**63), min(2**63 - 1, s))) for s, i in scores)[:10]
        assert [y[1:] for y in sorted(got[q])] == [(i, s) for _, i, s in want]


def test_pivot_bounds_save_work():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16)) * 3000
    x = (centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 16)) * 60).astype(np.int64)
    pivots = centres
    d = pivot_topk._distances(x.astype(float), pivots)
    found, evaluated = pivot_topk.search_block(np.arange(4000), x.astype(float), d, np.arange(50), x[:50].astype(float), d[:50])
    assert evaluated < 0.5 * 50 * 4000
    scores = x[:50] @ x.T
    for q in range(50):
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:10]
        assert [(i, s) for a, i, s, _ in found if a == q] == [(i, -s) for s, i in want]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    names = {"en": "the and of to in that with is for was on by".split(), "de": "der die und das nicht ist mit ein von zu auf im".split()}
    text = lambda lang, n: "\n".join(" ".join(r.choice(names[lang]) + r.choice(["", "a", "en", "x"]) for _ in range(20)) for _ in range(n))
    passage = text("en", 4)
    rows = [(i, text(lang := r.choice(list(names)), r.randint(1, 6)), lang, f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, text("en", 2) + "\n" + passage, "en", "s1", 0), (102, passage + "\n" + text("en", 2), "en", "s1", 0), (103, None, "en", "s1", 0), (104, "123", None, None, 0), (105, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == corpus_pipeline.COLUMNS
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids = {x.doc_id for x in kept.select("doc_id").collect()}
        assert not ids & {103, 104, 105}
        if name == "language ID":
            assert set(range(60)) | {100, 101, 102} == ids
        if name == "SimHash near-dedup":
            assert kept.where("doc_id is not null").count() == len(ids - {None}) and set(range(60)) - {0} <= ids | {0} and (0 in ids) and 100 not in ids
    packed = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in packed if x.piece == 0) == Counter(x.doc_id for x in kept.select("doc_id").collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
