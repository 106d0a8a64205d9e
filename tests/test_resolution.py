"""Clusters under cannot-link rules, survivors, redirects, audit and unmerge against plain versions."""

import random

import pytest

from ledgerlark.operators import resolution as R

ENTITY = "id long, name string, norm string, bn string, sources array<string>, links long"


def plain_clusters(entities, edges, key):
    """Edges one by one in order, each joining its clusters unless two numbers would meet."""
    of = {i: i for i in entities}
    numbers = dict(entities)
    for a, b, _ in sorted(edges, key=key):
        x, y = of[a], of[b]
        if x == y or None not in (numbers[x], numbers[y]) and numbers[x] != numbers[y]:
            continue
        numbers[x] = numbers[x] or numbers[y]
        of = {i: x if c == y else c for i, c in of.items()}
    return {frozenset(i for i in of if of[i] == c) for c in of.values()}


def as_sets(clusters):
    out = {}
    for r in clusters.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(s) for s in out.values()}


def spark_hashes(spark, edges):
    from pyspark.sql import functions as F

    return {(r.id_a, r.id_b): r.h for r in spark.createDataFrame([(a, b) for a, b, _ in edges], "id_a long, id_b long").select("id_a", "id_b", F.xxhash64("id_a", "id_b").alias("h")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_as_if_edges_came_one_by_one(spark, seed):
    r = random.Random(seed)
    entities = {i: r.choice([None, None, "1", "2", "3"]) for i in range(30)}
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(40)}
    edges = [(a, b, r.choice([1.0, 0.9, 0.7])) for a, b in pairs]
    hashes = spark_hashes(spark, edges)
    has = lambda i: entities[i] is not None
    want = plain_clusters(entities, edges, lambda e: (-e[2], has(e[0]) + has(e[1]), hashes[e[:2]], e[:2]))
    rows = spark.createDataFrame([(i, None, None, bn, ["fed"], 1) for i, bn in entities.items()], ENTITY)
    got = R.cannot_link_clusters(rows, spark.createDataFrame([(b, a, c) for a, b, c in edges], "id_a long, id_b long, confidence double"))
    assert as_sets(got) == want
    numbers = {}
    for x in got.collect():
        numbers.setdefault(x.cluster, set()).add(entities[x.id])
    assert all(len(n - {None}) <= 1 for n in numbers.values())


def test_a_large_star_takes_few_rounds_and_keeps_numbers_apart(spark):
    rows = spark.createDataFrame([(i, None, None, {1: "1", 2: "2"}.get(i), ["fed"], 1) for i in range(2000)], ENTITY)
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 2000)], "id_a long, id_b long, confidence double")
    sizes = sorted(len(s) for s in as_sets(R.cannot_link_clusters(rows, edges)))
    assert sizes == [1, 1999]


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        (1, "Oak Trust", "OAK TRUST", None, ["fed"], 9), (2, "OAK TRUST", "OAK TRUST", "120000001", ["cra"], 1), (3, "The Oak Trust", "OAK TRUST", None, ["ab"], 5),
        (4, "Oak Trust", "OAK TRUST", "120000002", ["cra"], 2), (5, "Elm O/A Oak Trust", "ELM", None, ["fed"], 1), (6, "Elm group", "ELM GROUP", "120000001", ["fed"], 3), (7, "Solo", "SOLO", None, ["fed"], 0), (8, None, "", None, ["fed"], 0),
    ]
    e = spark.createDataFrame(rows, ENTITY)
    found = R.candidates(e, spark.createDataFrame([(7, 3, 0.5), (7, 1, 0.99), (7, 2, 0.2)], "id_a long, id_b long, probability double"))
    return e, found


def test_tiers_and_conflicts(world):
    got = {(r.id_a, r.id_b): (r.method, r.confidence, r.status) for r in world[1].collect()}
    assert got == {
        (1, 2): ("norm_name", 1.0, "pending"), (1, 3): ("norm_name", 1.0, "pending"), (1, 4): ("norm_name", 1.0, "pending"),
        (2, 6): ("shared_bn", 0.99, "pending"), (1, 5): ("dba_oa", 0.88, "pending"), (3, 7): ("splink_match", 0.5, "pending"),
    }
    entities, _ = world
    apart = R.candidates(entities.where("id in (2, 4)")).first()
    assert apart.status == "different"


def test_merge_redirect_audit_and_unmerge(spark, world):
    entities, found = world
    edges = found.where("confidence > 0.8")
    clusters = R.cannot_link_clusters(entities, edges)
    kept = R.survivors(clusters, entities)
    to = {r.id: r.survivor for r in kept.collect()}
    with_one = to[1]
    assert with_one in (2, 4) and {to[3], to[5]} == {with_one} and to[7] == 7 and to[8] == 8 and to[2] != to[4] and to[6] == 2
    links = spark.createDataFrame([(10, 1), (11, 3), (12, 7), (13, 4)], "link long, entity_id long")
    moved = R.redirected(links, kept)
    assert {r.link: r.entity_id for r in moved.collect()} == {10: with_one, 11: with_one, 12: 7, 13: 4}
    assert sorted(map(tuple, R.redirected(moved, kept).collect())) == sorted(map(tuple, moved.collect()))
    rows = {r.survivor: r for r in R.merged(entities, kept).collect()}
    assert rows[with_one].members >= 4 and "Elm O/A Oak Trust" in rows[with_one].names and sum(r.links for r in rows.values()) == 21
    log = R.audit(edges, kept, links)
    assert {(r.id_a, r.id_b): r.links_redirected for r in log.collect()}[1, 3] == 2
    again = {r.id: r.survivor for r in R.unmerged(entities, log, spark.createDataFrame([(3, 1)], "id_a long, id_b long")).collect()}
    assert again[3] == 3 and again[1] == with_one and 7 not in again
    whole = {r.id: r.survivor for r in R.unmerged(entities, log, log.limit(0)).collect()}
    assert whole == {}


def test_pending_names(spark, world):
    rows = [(1, "SOLO", None), (2, "Oak trust, .", None), (3, "Chêne | Solo", None), (4, "Pine TRADE NAME OF Solo", None), (5, "whatever", "120000002"), (6, "new", "120000009"), (7, "Nobody knows", None), (8, "-", None), (9, None, None), (10, "other", "120000009")]
    got = {r.id: (r.entity, r.method, r.confidence) for r in R.resolve_pending(spark.createDataFrame(rows, "id long, name string, bn string"), world[0]).collect()}
    assert got[1] == ("7", "exact_name", 0.95) and got[2] == ("1", "normalized", 0.90) and got[3] == ("7", "pipe_split", 0.88) and got[4] == ("7", "trade_name", 0.88)
    assert got[5] == ("4", "bn_anchor", 0.99) and got[6] == got[10] == ("bn:120000009", "bn_new", 0.85) and got[7] == ("name:NOBODY KNOWS", "new_name", 0.70) and got[8] == got[9] == (None, None, None)


def test_nothing_to_resolve(spark, world):
    empty = world[0].limit(0)
    assert R.candidates(empty).count() == 0 and R.cannot_link_clusters(empty, world[1].limit(0)).count() == 0


def test_profiles_seek_candidates_once(spark, monkeypatch):
    from ledgerlark.operators import resolution
    from ledgerlark.plans import QUERIES

    calls = []
    none = "id_a long, id_b long, method string, confidence double, status string"
    monkeypatch.setattr(resolution, "candidates", lambda *a, **k: calls.append(1) or spark.createDataFrame([], none))
    QUERIES["golden_profiles"].build(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
