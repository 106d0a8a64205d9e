"""The inverted index against plain search, and what a search reads."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import textindex as I


def plain_stem(w):
    w = w[:-2] if w.endswith("sses") else w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w
    return w[:-3] if w.endswith("ing") and len(w) >= 6 else w[:-2] if w.endswith(("ed", "ly")) and len(w) >= 5 else w


WORDS = "grants granted granting parties party passes pass is as bus closely fed ring kings the of charity charities".split()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 25))).title() + r.choice([".", "", "!"])) for i in range(200)] + [(900, None), (901, ""), (None, "grants"), (902, "the " * 3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    return dict(docs), I.write_index(table, str(tmp_path_factory.mktemp("index") / "postings"), shards=8)


def test_stems(spark):
    assert I.stems(spark, WORDS) == [plain_stem(w) for w in WORDS]


@pytest.mark.parametrize("asked", [
    I.Search(all_of=["grant", "the"]), I.Search(any_of=["kings", "bus"], none_of=["party"]), I.Search(phrase=["grants", "the"]), I.Search(phrase=["the", "the", "the"]), I.Search(beginning="char", all_of=["pass"]), I.Search(beginning="gr"), I.Search(all_of=["nowhere"]),
])
def test_search(index, asked):
    docs, stored = index
    got = {r.doc: (round(r.score, 9), r.phrase_hits) for r in I.search(stored, asked, shards=8).collect()}
    must, some, never, phrase = ([plain_stem(w) for w in x] for x in (asked.all_of, asked.any_of, asked.none_of, asked.phrase))
    want = {}
    for doc, text in docs.items():
        t = [plain_stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        hits = sum(t[i : i + len(phrase)] == phrase for i in range(len(t))) if phrase else 0
        begins = [w for w in t if asked.beginning and w.startswith(asked.beginning)]
        if doc is None or not t or any(w not in t for w in must) or some and not set(some) & set(t) or set(never) & set(t) or phrase and not hits or asked.beginning and not begins:
            continue
        n = sum(w in {*must, *some, *phrase} or bool(asked.beginning) and w.startswith(asked.beginning) for w in t)
        want[doc] = round(n / len(t), 9), hits
    assert got == want


def test_only_the_shards_of_the_asked_terms_are_read(index):
    _, stored = index
    plan = I.asked_postings(stored, ["grant"], shards=8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert {r.term for r in I.asked_postings(stored, ["grant"], shards=8).select("term").distinct().collect()} == {"grant"}
    with pytest.raises(ValueError):
        I.search(stored, I.Search(none_of=["the"]))


def test_a_common_term_is_many_rows(index):
    assert index[1].where("term = 'the'").count() > 100 and index[1].agg(F.max(F.size("positions"))).first()[0] == 3000


def test_words_are_not_exchanged(spark, tmp_path, monkeypatch, capsys):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 60)))) for i in range(300)] + [(None, "kings"), (900, None), (901, "..."), (902, "Ring of rings, \u00e9RING")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for doc, text in docs:
        t = [plain_stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        for i, w in enumerate(t if doc is not None else []):
            want.setdefault((w, doc), ([], len(t)))[0].append(i)
    I.postings(table).explain()
    assert "Exchange" not in capsys.readouterr().out
    monkeypatch.setattr(I, "TASK_TEXT", sum(len((t or "").encode()) for _, t in docs) // 9, raising=False)
    stored = I.write_index(table, str(tmp_path / "postings"), shards=8)
    got = stored.withColumn("task", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).collect()
    assert {(x.term, x.doc): (x.positions, x.size) for x in got} == want and len(got) == len(want)
    tasks = {x.doc: set() for x in got}
    for x in got:
        tasks[x.doc].add(x.task)
    assert all(len(t) == 1 for t in tasks.values()) and len(set().union(*tasks.values())) >= 9  # a document's postings are of the task that read it
    for _, part in itertools.groupby(sorted(got, key=lambda x: (x.task, x.shard)), key=lambda x: (x.task, x.shard)):
        terms = [x.term for x in part]
        assert terms == sorted(terms)
