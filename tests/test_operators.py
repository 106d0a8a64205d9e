"""Operators against plain Python on random inputs, and their handling of odd rows."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import aggregate as A
from ledgerlark.operators import compare as C
from ledgerlark.operators import entity as E
from ledgerlark.operators import graph as G
from ledgerlark.operators import latest as L
from ledgerlark.operators import rules as R
from ledgerlark.operators import scores as S
from ledgerlark.operators import similarity as M
from ledgerlark.operators import topk as K

EDGES = "src long, dst long, total_amt double, min_year int, max_year int"


def random_edges(seed, nodes=9, n=26):
    r = random.Random(seed)
    pairs = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)}
    return [(a, b, float(r.randint(1, 99)), y := r.randint(2000, 2003), y + r.randint(0, 1)) for a, b in sorted(pairs) if a != b]


def plain_cycles(edges, k, window=None):
    out = {a: {} for a, *_ in edges} | {}
    for e in edges:
        out.setdefault(e[0], {})[e[1]] = e
    found = set()
    for nodes in itertools.permutations({x for e in edges for x in e[:2]}, k):
        if nodes[0] != min(nodes):
            continue
        hops = [out.get(a, {}).get(b) for a, b in zip(nodes, nodes[1:] + nodes[:1])]
        if all(hops) and (window is None or max(h[4] for h in hops) - min(h[3] for h in hops) <= window):
            found.add((">".join(map(str, nodes)), min(h[2] for h in hops)))
    return found


@pytest.mark.parametrize("seed, window", [(1, None), (2, 1)])
def test_cycles(spark, seed, window):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, EDGES)
    for k in (2, 3, 4):
        got = {(x.path_key, x.bottleneck) for x in G.cycles(df, k, window).collect()}
        assert got == plain_cycles(edges, k, window)


def plain_reach(edges):
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e[:2]}:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return reach


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components_and_pruning(spark, seed):
    edges = random_edges(seed, 14, 24)
    df = spark.createDataFrame(edges, EDGES)
    reach = plain_reach(edges)
    want = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in reach}
    assert {x.node: x.component for x in G.strong_components(df).collect()} == want
    left = {(a, b) for a, b, *_ in edges}
    while True:
        keep = {(a, b) for a, b in left if any(y == a for _, y in left) and any(x == b for x, _ in left)}
        if keep == left:
            break
        left = keep
    assert {(x.src, x.dst) for x in G.prune_dead_ends(df.select("src", "dst")).collect()} == left


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert G.strong_components(none).count() == 0 and G.all_cycles(none, 3).count() == 0 and G.hubs(none).count() == 0


def test_closed_walks(spark):
    edges = random_edges(5, 6, 14)
    adj = {(a, b) for a, b, *_ in edges}
    nodes = {x for e in adj for x in e}
    want = {(n, 3): c for n in nodes if (c := sum((n, a) in adj and (a, b) in adj and (b, n) in adj for a in nodes for b in nodes))}
    got = {(x.node, x.k): x.walks for x in G.closed_walks(spark.createDataFrame(edges, EDGES), 3).where("k = 3").collect()}
    assert got == want


def test_trigram_join_finds_every_pair(spark):
    r = random.Random(6)
    words = ["harbour", "harbor", "society", "societies", "food", "bank", "centre", "center"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for i in range(60)] + [(100, None), (101, ""), (102, "abc")]
    grams = lambda s: {(f"  {w} ")[k : k + 3] for w in s.split() for k in range(len(w) + 1)}
    long = [(i, t) for i, t in rows if t and len(t) >= 5]
    want = {(i, j) for i, a in long for j, b in long if i < j and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6}
    got = {(x.id_a, x.id_b) for x in M.trigram_join(spark.createDataFrame(rows, "id long, name string"), 0.6).collect()}
    assert got == want


def joined_groups(pairs, ids):
    """The least id that each id is linked to by pairs."""
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_trigram_join_links_copies_to_one(spark):
    rows = [(i, "northern food bank") for i in range(300)] + [(900, "northern food banks"), (901, "bank, northern food"), (902, None)]
    df = spark.createDataFrame(rows, "id long, name string")
    got = [(x.id_a, x.id_b) for x in M.trigram_join(df, 0.7, copies=False).collect()]
    assert len(got) == len(set(got)) == 301 and set(joined_groups(got, [*range(300), 900, 901]).values()) == {0}
    assert M.trigram_join(df, 0.7).count() == 302 * 301 // 2


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most, seed", [(1, 21), (2, 22), (5, 23)])
def test_levenshtein_match_finds_every_pair(spark, most, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(60)]
    for _ in range(60):  # edited copies, ends and middles moved
        t = list(r.choice(texts) + "dédale"[: r.randint(0, 6)])
        for _ in range(r.randint(0, most + 1)):
            k = r.randint(0, len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
        texts.append("".join(t))
    rows = [(i, "k" if i % 3 else "m", t) for i, t in enumerate(texts)] + [(500, None, "abc"), (501, "k", None), (502, None, None)]
    df = spark.createDataFrame(rows, "id long, k string, name string")
    want = {}
    for (i, k, a), (j, m, b) in itertools.combinations(rows[: len(texts)], 2):
        if k == m and (d := plain_distance(a[:12], b[:12])) <= most:
            want[i, j] = (d, round(1 - d / max(len(a[:12]), len(b[:12]), 1), 6))
    got = M.levenshtein_match(df, ["k"], most, 12).collect()
    assert {(x.id_a, x.id_b): (x.distance, x.confidence) for x in got} == want and len(got) == len(want)
    some = [(x.id_a, x.id_b) for x in M.levenshtein_match(df, ["k"], most, 12, copies=False).collect()]
    assert joined_groups(some, range(len(texts))) == joined_groups(want, range(len(texts)))


def plain_jaro_winkler(a, b):
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                hits.append(c)
                break
    if not hits:
        return 0.0
    m, swaps = len(hits), sum(x != b[j] for x, j in zip(hits, sorted(used))) // 2  # whole swaps, as DuckDB counts them
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4]))))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler(spark):
    r = random.Random(24)
    word = lambda: "".join(r.choice("abcé\U0001f600") for _ in range(r.randint(0, 12)))
    rows = [(word(), word()) for _ in range(800)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("same", "same"), ("", ""), ("a" * 3000, "a" * 2999 + "b"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select("a", "b", M.jaro_winkler("a", "b").alias("s")).collect()
    for x in got:
        want = None if x.a is None or x.b is None else plain_jaro_winkler(x.a, x.b)
        assert x.s is None if want is None else abs(x.s - want) < 1e-12
    assert abs(next(x.s for x in got if x.a == "martha") - 0.961111) < 1e-6
    plain = [x for x in got if x.a and x.b and x.a.isascii() and x.b.isascii() and len(x.a) < 100]
    theirs = [duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [x.a, x.b]).fetchone()[0] for x in plain]
    assert all(abs(x.s - v) < 1e-9 for x, v in zip(plain, theirs))


def test_blocked_pairs_once_each(spark):
    r = random.Random(25)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y", "z", None]), r.randint(0, 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, p string, q string, n long")
    eq = lambda u, v: u is not None and u == v
    want = sorted((s[0], t[0], s[3], t[3]) for s, t in itertools.combinations(rows, 2) if eq(s[1], t[1]) and eq(s[2], t[2]) or s[3] == t[3] or eq(s[2], t[2]) and s[3] == t[3])
    got = sorted(tuple(x) for x in M.blocked_pairs(df, [["p", "q"], ["n"], ["q", "n"]], ["n"]).select("id_a", "id_b", "n_a", "n_b").collect())
    assert got == want
    links = [(x.id_a, x.id_b) for x in M.same_key(df, ["p", "q"]).collect()]
    assert joined_groups(links, range(60)) == {s[0]: min([s[0], *(t[0] for t in rows if eq(s[1], t[1]) and eq(s[2], t[2]))]) for s in rows}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_shared_people(spark, least):
    r = random.Random(26)
    rows = [(r.randrange(25), r.randrange(40), 2000 + r.randrange(6)) for _ in range(220)] + [(o, 99, 2003) for o in range(25)] + [(3, None, 2000), (None, 99, 2000)]
    seats = {}
    for o, p, y in rows:
        if o is not None and p is not None:
            seats.setdefault(o, {}).setdefault(p, []).append(y)
    want = set()
    for a, b in itertools.combinations(sorted(seats), 2):
        both = seats[a].keys() & seats[b].keys()
        if len(both) >= least:
            want.add((a, b, len(both), min(max(min(seats[a][p]), min(seats[b][p])) for p in both), max(min(max(seats[a][p]), max(seats[b][p])) for p in both)))
    got = [tuple(x) for x in G.shared_people(spark.createDataFrame(rows, "org long, person long, year int"), least).collect()]
    assert set(got) == want and len(got) == len(want)


def test_clusters(spark):
    r = random.Random(7)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(50)]
    group = {x: x for p in pairs for x in p}
    for _ in range(80):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {x.id: x.cluster for x in E.merge_clusters(spark.createDataFrame(pairs, "id_a long, id_b long")).collect()}
    assert got == group


def test_linkage_likelihood_never_falls(spark):
    r = random.Random(8)
    rows = [(int(m := r.random() < 0.3), r.choice([0, 1, 2]) if not m else 2, int(r.random() < (0.9 if m else 0.1))) for _ in range(3000)]
    p = spark.createDataFrame([(a, b) for _, b, a in rows], "x int, y int")
    m, u, share, seen = E.fellegi_sunter(E.agreement_patterns(p, [F.col("x"), F.col("y")]), [2, 3], prior=0.1)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and 0.15 < share < 0.45 and m[0][1] > u[0][1]


def test_merging_twice_changes_nothing(spark):
    e = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"])], "entity_id long, names array<string>")
    c = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")
    first = E.merge_entities(e, c)
    again = E.merge_entities(first.select(F.col("survivor").alias("entity_id"), "names"), c)
    assert {x.survivor: x.names for x in first.collect()} == {x.survivor: x.names for x in again.collect()} == {1: ["a", "b"], 3: ["c"]}


def test_latest_agreement_orders_numbers(spark):
    rows = [(1, "A", "9", 10.0, "x1"), (1, "A", "10", 12.0, "x2"), (1, None, "0", 5.0, "x3"), (2, "B", None, None, "x4")]
    df = spark.createDataFrame(rows, "ref_number long, bn string, amendment_number string, agreement_value double, line_id string").withColumn("recipient", F.lit(None).cast("string")).withColumn("amendment_date", F.lit(None).cast("date"))
    got = {x.line_id for x in L.current_agreements(L.with_agreement_key(df)).collect()}
    assert got == {"x2", "x3", "x4"}


def test_concentration_invariants(spark):
    r = random.Random(9)
    rows = [(r.choice("xy"), f"v{r.randrange(9)}", float(r.randint(-5, 50))) for _ in range(200)]
    c = A.concentration(spark.createDataFrame(rows, "cell string, vendor string, amount double"), ["cell"], "vendor", "amount")
    assert c.where(~A.concentration_ok()).count() == 0 and c.count() == 2


def test_identity_rules_name_the_failure(spark):
    rows = [(1, 10.0, 4.0, 6.0), (2, None, 4.0, None), (3, 10.0, None, None), (4, 10.0, 4.0, 4.0), (5, None, None, None), (6, 0.5, None, None)]
    df = spark.createDataFrame(rows, "k long, t double, a double, b double")
    got = {(x.k, x.failure) for x in R.identity_violations(df, [R.Identity("sum", "t", ("a", "b"))], ["k"]).collect()}
    assert got == {(2, "TOTAL_MISSING"), (3, "PARTS_MISSING"), (4, "SUM_MISMATCH")}


def test_differences(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, None)], "k long, v double")
    b = spark.createDataFrame([(1, 100.5), (2, 200.0), (3, None), (4, 1.0)], "k long, v double")
    assert {x.k: x.status for x in C.diff(a, b, ["k"], ["v"]).collect()} == {1: "match", 2: "differs", 3: "match", 4: "only_b"}


def test_balanced_choice_covers(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 5}", i) for i in range(60)]
    got = K.balanced(spark.createDataFrame(rows, "id long, a string, b string, v long"), [["a"], ["b"]], [F.col("v").desc(), F.col("id")], 10, "id").collect()
    assert {x.a for x in got} == {"a0", "a1", "a2"} and {x.b for x in got} == {f"b{i}" for i in range(5)}


def test_yearly_reconciliation_flags(spark):
    g = spark.createDataFrame([("1", 2020, 100_000.0), ("2", 2020, 100_000.0), ("3", 2020, 100_000.0), ("4", 2020, 100_000.0), ("5", 2020, 100_000.0)], "bn string, year int, amount double")
    f = spark.createDataFrame([("1", 2021, 95_000.0), ("2", 2019, 60_000.0), ("3", 2020, 10_000.0), ("4", 2010, 99_000.0)], "bn string, year int, revenue double")
    got = {x.bn: x.flag for x in S.reconcile_yearly(g, f).collect()}
    assert got == {"1": "RECONCILED", "2": "SLIGHTLY_HIGHER", "3": "MUCH_HIGHER", "4": "REPORTS_ZERO"}


def test_long_chains_and_rings(spark):
    """Depth is no limit: a chain goes whole, a ring is one component, tails stay alone."""
    n = 1200
    ring = [(i, (i + 1) % n) for i in range(n)]
    edges = ring + [(10_000 + i, 10_001 + i) for i in range(n)] + [(5, 20_000), (20_000, 20_001), (20_001, 6), (30_000, 30_001), (30_001, 30_000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    left = {(x.src, x.dst) for x in G.prune_dead_ends(df).collect()}
    assert left == set(ring) | {(5, 20_000), (20_000, 20_001), (20_001, 6), (30_000, 30_001), (30_001, 30_000)}
    parts = {x.node: x.component for x in G.strong_components(df).collect()}
    assert all(parts[i] == 0 for i in [*range(n), 20_000, 20_001]) and parts[30_001] == 30_000
    assert all(parts[10_000 + i] == 10_000 + i for i in range(n + 1))


def test_a_cycle_passes_no_node_twice(spark):
    """A to B to X to B to D to A is no cycle; what it is made of is."""
    a, b, x, dd = 1, 2, 3, 4
    df = spark.createDataFrame([(s, t, 1.0, 2000, 2000) for s, t in ((a, b), (b, x), (x, b), (b, dd), (dd, a))], "src long, dst long, total_amt double, min_year int, max_year int")
    assert {r.path_key for r in G.all_cycles(df, 8).collect()} == {"2>3", "1>2>4"}


def test_linkage_finds_the_records_of_one_body(spark):
    from ledgerlark.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    model = QUERIES["linkage_model"].build(spark, sf).collect()
    for name in {x.comparison for x in model}:
        rows = [x for x in model if x.comparison == name]
        assert abs(sum(x.m for x in rows) - 1) < 1e-4 and abs(sum(x.u for x in rows) - 1) < 1e-4
    found = QUERIES["linkage_matches"].build(spark, sf).collect()
    truth = {x.c_custkey for x in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    right = {x.id_a for x in found if x.id_b == x.id_a + 10**9}
    assert len(right) >= 0.9 * len({x.id_a for x in found}) and len(right) > 0.3 * len(truth)
    assert all(0.4 <= x.probability <= 1 and x.cluster <= x.id_a for x in found)
