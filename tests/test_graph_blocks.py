"""Cycles that meet in the middle and graph steps in blocks, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import blocks
from ledgerlark.operators import graph as G
from ledgerlark.operators import half_cycles as H

EDGE = "src long, dst long, total_amt long, min_year int, max_year int"


def random_edges(r, nodes, n, hub=None):
    pairs = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)}
    pairs |= {(hub, v) for v in range(nodes)} | {(v, hub) for v in range(nodes)} if hub is not None else set()
    return [(a, b, r.randint(1, 99), y := r.randint(2000, 2004), y + r.randint(0, 1)) for a, b in sorted(pairs) if a != b]


def plain_cycles(edges, most, window=None):
    out, after = [], {}
    for e in edges:
        after.setdefault(e[0], []).append(e)

    def walk(path, used):
        for e in after.get(path[-1], []):
            some = [*used, e]
            if window is not None and max(x[4] for x in some) - min(x[3] for x in some) > window:
                continue
            if e[1] == path[0] and len(path) > 1:
                out.append((">".join(map(str, path)), len(path), min(x[2] for x in some), sum(x[2] for x in some)))
            elif e[1] > path[0] and e[1] not in path and len(path) < most:
                walk([*path, e[1]], some)

    for v in after:
        walk([v], [])
    return sorted(out)


@pytest.mark.parametrize(("nodes", "n", "most", "window", "hub"), [(12, 34, 8, None, None), (14, 40, 7, 2, None), (9, 14, 5, None, 3), (30, 20, 8, None, None)])
def test_cycles_that_meet_in_the_middle(spark, nodes, n, most, window, hub):
    edges = random_edges(random.Random(nodes), nodes, n, hub)
    got = H.cycles_by_halves(spark.createDataFrame(edges, EDGE), most, window)
    assert sorted((r.path_key, r.hops, r.bottleneck, r.total_flow) for r in got.collect()) == plain_cycles(edges, most, window)


def test_large_graph_as_by_extension_with_fewer_rows_carried(spark):
    edges = spark.createDataFrame(random_edges(random.Random(2), 10_000, 17_000), EDGE)
    carried = []
    halves = H.cycles_by_halves(edges, 5, carried=carried)
    whole = G.all_cycles(edges, 5)
    same = ["path_key", "hops", "bottleneck", "total_flow", "min_year", "max_year"]
    assert sorted(map(tuple, halves.select(*same).collect())) == sorted(map(tuple, whole.select(*same).collect()))
    assert len(carried) == 5 and sum(carried) < edges.count() * 8
    with pytest.raises(ValueError):
        H.cycles_by_halves(edges, 9)


def plain_components(pairs):
    nodes = sorted({v for e in pairs for v in e})
    reach, size = {v: {v} for v in nodes}, 0
    while size != (size := sum(map(len, reach.values()))):
        for a, b in pairs:
            reach[a] |= reach[b]
    return {v: min(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_in_many_small_blocks(spark, monkeypatch, seed, kind):
    monkeypatch.setattr(blocks, "EDGES_AT_ONCE", 30)
    r = random.Random(seed)
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(70)} | {(i, i + 1) for i in range(100, 140)} | {(140, 100), (7, 7), (200, 200)} | {(0, v) for v in range(40)}
    show = (lambda v: v) if kind == "long" else (lambda v: f"n{v:03d}")
    edges = spark.createDataFrame([(show(a), show(b)) for a, b in pairs], f"src {kind}, dst {kind}")
    got = {x.node: x.component for x in G.strong_components(edges).collect()}
    assert got == {show(v): show(c) for v, c in plain_components(pairs).items()}


def test_pruning_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "EDGES_AT_ONCE", 40)
    n = 12
    grid = [(r * n + c, r * n + c + 1) for r in range(n) for c in range(n - 1)] + [(r * n + c, r * n + n + c) for r in range(n - 1) for c in range(n)]
    ring = [(1000 + k, 1000 + (k + 1) % 9) for k in range(9)]
    kept = G.prune_dead_ends(spark.createDataFrame(grid + ring + [(5, 1000), (1003, 7)], "src long, dst long"))
    assert sorted(map(tuple, kept.collect())) == sorted(ring)


@pytest.mark.parametrize("turns", [1, -1])
def test_ladders(spark, turns):
    m = 400
    edges = [(i, i + 1) for i in range(m - 1)] + [((m + i, m + i + 1)[::turns]) for i in range(m - 1)] + [(m + i, i) for i in range(m)] + [(i, m + i) for i in range(m)]
    sizes = G.strong_components(spark.createDataFrame(edges, "src long, dst long")).groupBy("component").count().collect()
    assert sorted(r["count"] for r in sizes) == ([2] * m if turns == 1 else [2 * m])


def test_reach_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "EDGES_AT_ONCE", 20)
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(61 + i, 60) for i in range(3)], "src long, dst long")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    got = {r.node: r.label for r in G._reach(nodes, edges).collect()}
    assert got == {i: i for i in range(64)}
    back = {r.node: r.label for r in G._reach(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).collect()}
    assert back == {i: 0 for i in range(64)}
