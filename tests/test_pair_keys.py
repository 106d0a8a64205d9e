"""Keys of similarity joins: few, exact, and never broadcast."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import similarity as M
from ledgerlark.operators import winkler as W


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_winkler_keys_tell_texts_apart():
    rank = {c: k for k, c in enumerate("qwertyuiopasdfghjklzxcvbnm ")}
    keys = lambda t: set(W.keys_of(t, 0.92, rank, [(12, 12), (13, 13)]))
    same = lambda t: {k for k in keys(t) if k & 3 == W.SAME}
    assert same("qwertyuiopasd") & same("qwertyuiopadz")
    assert not same("qwertyuiopasd") & same("qwertyuzxcvsd")  # nine of 13 in common: at most 0.87
    assert not {k >> 2 for k in keys("qwertyuiopasd") if k & 3 == W.LONGER} & {k >> 2 for k in keys("pqwertyuioasd") if k & 3 == W.SHORTER}  # equal lengths meet as equal ones only


def test_winkler_join_is_exact_over_lengths(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcde ", k=n)).strip() or "a" for n in [*range(1, 24)] * 3 + [25, 27, 30, 33, 40, 60]]
    near = [t[:i] + rng.choice("abc") + t[i + rng.choice([0, 1]) :] for t in base for i in (rng.randrange(len(t) + 1), len(t) // 2)]
    texts = sorted(set(base + near))
    for threshold in (0.82, 0.92):
        found = W.jaro_winkler_join(spark.createDataFrame(list(enumerate(texts)), "id long, name string"), threshold)
        got = {(r.id_a, r.id_b) for r in found.collect()}
        a, b = zip(*[(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))])
        like = M.jaro_winkler_values([texts[i] for i in a], [texts[j] for j in b])
        assert got == {(i, j) for i, j, v in zip(a, b, like) if v >= threshold - 1e-12}


def test_keys_are_not_broadcast(spark):
    keys = spark.range(10).select(F.col("id"), F.lit(3).alias("n"), F.col("id").alias("key"), F.lit(0).alias("at"), F.lit(1).alias("size"))
    plan = _plan(M._met(keys, keys, F.lit(1), F.lit(True)))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    texts = spark.createDataFrame([(1, "k", "abc"), (2, "k", "abd")], "id long, k string, t string")
    plan = _plan(M._short_texts_met(texts, ["k"], 1))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_blocks_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 3)
    rows = spark.range(10).select("id", F.lit("k").alias("k")).unionByName(spark.range(20, 22).select("id", F.lit("j").alias("k")))
    pairs = M.blocked_pairs(rows, [["k"]], [])
    assert "piece" in _plan(pairs) and sorted(map(tuple, pairs.collect())) == sorted([(i, j) for i in range(10) for j in range(i + 1, 10)] + [(20, 21)])


def test_blocked_similarity_with_copies_and_nulls(spark):
    rows = [(1, "x", "oak"), (2, "x", "oak"), (3, "x", "oaks"), (4, "x", None), (5, "x", ""), (6, "x", ""), (7, "y", "oak"), (8, "x", "oaks")]
    got = {(r.id_a, r.id_b): r.similarity for r in M.jaro_winkler_blocked(spark.createDataFrame(rows, "id long, k string, name string"), ["k"]).collect()}
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]]
    want = {(a[0], b[0]): None if None in (a[2], b[2]) else float(M.jaro_winkler_values([a[2]], [b[2]])[0]) for a, b in pairs}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)


def _dealt_rows(spark):
    """Rows that all stages so far have written for others to read."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def _texts(n, seed):
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    texts = [f"{word('abeghiknrt')} {word('clomdpsuvy')} {rng.choice(['building', 'furniture'])}" for _ in range(n)]
    return sorted({*texts, *(t[:i] + "w" + t[i + 1 :] for t, i in zip(texts[::3], itertools.cycle(range(12))))})


@pytest.mark.parametrize("join", ["trigram_join", "levenshtein_match"])
def test_keys_are_made_where_they_meet(spark, join):
    texts = _texts(300, 5)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    before = _dealt_rows(spark)
    found = (M.trigram_join(rows, 0.65) if join == "trigram_join" else M.levenshtein_match(rows, [], 3)).collect()
    assert _dealt_rows(spark) - before < 100 * len(texts)  # with each key dealt there were some 300 a text
    grams = [{f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)} for t in texts]
    alike = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.65
    near = lambda i, j: duckdb.execute("SELECT levenshtein(?, ?)", [texts[i], texts[j]]).fetchone()[0] <= 3
    close = alike if join == "trigram_join" else near
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) > 8 and close(i, j)}
    assert {(r.id_a, r.id_b) for r in found} == want and len(want) >= 90
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_similar_texts_are_compared_where_they_meet(spark):
    texts = sorted({t[:13] for t in _texts(400, 7)} | {f"{t[:6]} trade" for t in _texts(300, 8)})
    ids = [*enumerate(texts), *((i + 10_000, t) for i, t in enumerate(texts[:40]))]
    before = _dealt_rows(spark)
    got = {(r.id_a, r.id_b): r.similarity for r in W.jaro_winkler_join(spark.createDataFrame(ids, "id long, name string"), 0.85).collect()}
    dealt = _dealt_rows(spark) - before
    pairs = list(itertools.combinations(ids, 2))
    like = M.jaro_winkler_values([a[1] for a, _ in pairs], [b[1] for _, b in pairs])
    want = {(a[0], b[0]): v for (a, b), v in zip(pairs, like) if v >= 0.85 - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert dealt < 100 * len(texts) + 5 * len(want)  # with each key and each pair that met dealt there were some 400 a text more


def test_longer_prefixes_have_keys_only_where_fewer_characters_match():
    assert [(k, until) for k, _, until in W._levels(13, (13, 13), 0.92)] == [(0, 3), (3, 0)]
    assert len(W.keys_of("qwertyuiopasd", 0.92, {}, [(13, 13)])) < 60  # 110 with keys for each prefix


def test_pairs_of_single_texts_are_not_dealt(spark):
    rows = [(i, "x", f"supplier {i}") for i in range(300)] + [(1000 + i, "x", f"supplier {i % 3}") for i in range(9)]
    before = _dealt_rows(spark)
    got = {(r.id_a, r.id_b): r.similarity for r in M.jaro_winkler_blocked(spark.createDataFrame(rows, "id long, k string, name string"), ["k"]).collect()}
    assert _dealt_rows(spark) - before < 15_000  # with each of the 44,850 pairs of different texts dealt several times there were over 100,000
    pairs = list(itertools.combinations(rows, 2))
    like = M.jaro_winkler_values([a[2] for a, _ in pairs], [b[2] for _, b in pairs])
    assert got.keys() == {(a[0], b[0]) for a, b in pairs} and all(abs(got[a[0], b[0]] - v) < 1e-9 for (a, b), v in zip(pairs, like))
