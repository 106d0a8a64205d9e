"""What one task holds does not grow with the tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import graph as G
from ledgerlark.operators import resolution as R
from ledgerlark.operators import scores as S
from ledgerlark.operators import similarity as M
from ledgerlark.operators import textindex as I
from ledgerlark.plans.views import view
from ledgerlark.sources import store


def test_lines_of_wide_views_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    for name in ("agreements", "contracts"):
        each = [r["count"] for r in view(spark, "/root/testdata/sf0.001", name).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(each) >= 10 and max(each) < 1500  # 6,000 lines; by the four partitions of the session a task had 1,500 and more


def test_queue_deals_the_cases_of_one_module(spark, monkeypatch, capsys):
    rows = [("m", f"c{i:04}", f"e{i % 7}", i % 101) for i in range(1000)] + [("n", "x", "e1", 5)]
    cases = spark.createDataFrame(rows, "module string, case_id string, entity string, score long")
    monkeypatch.setattr(store, "TASK_ROWS", 50)
    q = S.action_queue(cases, 40)
    q.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    got = {(r.module, r.case_id): (r.turn, r.signals) for r in q.collect()}
    best = sorted((r for r in rows if r[0] == "m"), key=lambda r: (-r[3], r[1]))[:40]
    assert got == {("m", r[1]): (k, 2 if r[2] == "e1" else 1) for k, r in enumerate(best, 1)} | {("n", "x"): (1, 2)}


def test_shared_people_looks_nobody_up_again(spark, monkeypatch):
    r = random.Random(5)
    rows = sorted({(o, p, r.randint(1990, 2000)) for o in range(40) for p in [0, 1, *r.sample(range(2, 60), 6)]})
    seen, keep = {}, G.written
    monkeypatch.setattr(G, "written", lambda df, label: seen.setdefault(label, keep(df, label)))
    df = spark.createDataFrame([*rows, (None, 1, 1990), (3, None, 1990)], "org int, person int, year int")
    for least in (1, 2, 3, 4):
        seen.clear()
        seats = {}
        for o, p, y in rows:
            a, b = seats.setdefault(o, {}).get(p, (y, y))
            seats[o][p] = (min(a, y), max(b, y))
        want = {}
        for a, b in itertools.combinations(range(40), 2):
            both = [(max(seats[a][p][0], seats[b][p][0]), min(seats[a][p][1], seats[b][p][1])) for p in seats[a].keys() & seats[b].keys()]
            if len(both) >= least:
                want[a, b] = (len(both), min(x for x, _ in both), max(y for _, y in both))
        got = {(x.org_a, x.org_b): (x.shared_people, x.overlap_first_year, x.overlap_last_year) for x in G.shared_people(df, least).collect()}
        assert got == want
        assert least == 1 or "n" in seen["met"].columns  # pairs come with the people through whom they met


def test_pending_names_are_normalised_once(spark, monkeypatch):
    seen, keep = {}, R.written
    monkeypatch.setattr(R, "written", lambda df, label: seen.setdefault(label, keep(df, label)))
    pending = spark.createDataFrame([(1, "Old trade name of Oak", None), (2, "x | Oak", None), (3, "The Elm", None)], "id long, name string, bn string")
    entities = spark.createDataFrame([(7, "Oak", "OAK", None)], "id long, name string, norm string, bn string")
    got = {r.id: (r.entity, r.method) for r in R.resolve_pending(pending, entities).collect()}
    assert got == {1: ("7", "trade_name"), 2: ("7", "pipe_split"), 3: ("name:ELM", "new_name")}
    assert {"norm", "bar", "trade"} <= set(seen["pending"].columns)


@pytest.mark.parametrize("join", ["levenshtein_match", "trigram_join"])
def test_pairs_of_copies_are_as_many_tasks_as_they_need(spark, monkeypatch, join):
    monkeypatch.setattr(M, "PAIRS_A_TASK", 2000, raising=False)
    monkeypatch.setattr(M, "LISTED", 20, raising=False)
    sizes = {"oak trust of elms": 300, "oak trust of elm": 90, "oak trust off elms": 1, "quite another name": 31, "alone": 1}
    names = [n for n, k in sizes.items() for _ in range(k)]
    random.Random(3).shuffle(names)
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    kind = {n: "other" if n[0] == "q" else "alone" if n[0] == "a" else "oak" for n in sizes}
    found = M.levenshtein_match(rows, [], 2) if join == "levenshtein_match" else M.trigram_join(rows, 0.7)
    got = found.withColumn("task", F.spark_partition_id()).collect()
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if kind[a] == kind[b]}
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) == 391 * 390 // 2 + 31 * 30 // 2
    assert all((names[r.id_a] == names[r.id_b]) == ((r.distance == 0) if "distance" in found.columns else (r.similarity == 1.0)) for r in got)
    most = max(sum(1 for _ in g) for _, g in itertools.groupby(sorted(r.task for r in got)))
    assert most < 3 * 2000  # by the four partitions of the session a task had 10,000 and more
