"""Percentiles, reversals, histories, checksum trees, gates and the Jaro-Winkler join against plain versions."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import checksums as C
from ledgerlark.operators import exact as X
from ledgerlark.operators import history as H
from ledgerlark.operators import winkler as W
from ledgerlark.operators.similarity import jaro_winkler_values
from ledgerlark.sources import sinks as S


def test_percentiles(spark):
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(3000)], "b": [r.choice([1.0, 2.0]) for _ in range(100)], "c": [5.0], "d": [10.0**k for k in range(-300, 300, 7)], None: [r.expovariate(1) for _ in range(50)], "e": [0.1, float(np.nextafter(0.1, 1)), float(np.nextafter(0.1, 0)), -1e308, 1e308], "f": [5e-324, 0.0, 1e-323]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("a", None), ("z", None), ("b", float("nan"))]
    got = {x.k: x for x in X.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"low": 0.01, "median": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, p in (("low", 0.01), ("median", 0.5), ("p99", 0.99), ("top", 1.0)):
            s, at = sorted(xs), p * (len(xs) - 1)
            want = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
            assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)


def test_reversals(spark):
    r = random.Random(2)
    rows = [(i, r.choice("uv"), r.choice([5, -5, 5, -5, 7, -7, 0, None]), r.randint(0, 20)) for i in range(300)] + [(1000 + i, "n", 9, 1) for i in range(6)] + [(2000 + i, "n", -9, 2) for i in range(4)] + [(3000, "n", -9, 0)]
    want, waiting = set(), {}
    for i, v, a, d in sorted(rows, key=lambda x: (x[3], x[0])):
        if a and a > 0:
            waiting.setdefault((v, a), []).append(i)
        elif a and waiting.get((v, -a)):
            want.add((v, -a, waiting[v, -a].pop(0), i))
    got = X.matched_reversals(spark.createDataFrame(rows, "id long, v string, amount long, day int"), ["v"])
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


DAY = date(2000, 1, 1)


def test_valid_on(spark):
    r = random.Random(3)
    spells = [(k, f"{k}{i}", DAY + timedelta(days=i * 400 + k), None if i == 3 else DAY + timedelta(days=(i + 1) * 400 + k)) for k in range(3) for i in range(4)] + [(0, "over", DAY + timedelta(days=500), DAY + timedelta(days=510))]
    rows = [(r.choice([0, 1, 2, 9, None]), DAY + timedelta(days=r.randint(-50, 2500)), i % 7) for i in range(200)] + [(1, None, 0)]
    rows += rows[:5]
    got = H.valid_on(spark.createDataFrame(rows, "k int, day date, x int"), spark.createDataFrame(spells, "k int, name string, valid_from date, valid_to date"), ["k"], "day", ["name"])
    want = []
    for k, day, x in rows:
        hit = [s for s in spells if s[0] == k and day is not None and s[2] <= day and (s[3] is None or day < s[3])]
        want.append((k, day, x, max(hit, key=lambda s: s[2])[1] if hit else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_spells_and_rebrands(spark):
    rows = [(1, "Oak", 0), (1, "Oak", 5), (1, "Elm", 9), (1, "Oak", 400), (1, "OAK", 401), (2, "Ash", 1), (2, None, 3), (None, "x", 1), (3, "b", 1), (3, "a", 1)]
    t = spark.createDataFrame([(k, n, DAY + timedelta(days=d)) for k, n, d in rows], "k int, name string, day date")
    got = sorted((r.k, r.name, (r.first_day - DAY).days, (r.last_day - DAY).days, r.valid_to and (r.valid_to - DAY).days) for r in H.spells(t, "k", "name", "day").collect())
    assert got == [(1, "Elm", 9, 9, 400), (1, "OAK", 401, 401, None), (1, "Oak", 0, 5, 9), (1, "Oak", 400, 400, 401), (2, "Ash", 1, 1, None), (3, "a", 1, 1, None)]
    changes = sorted((r.number, r.old_name, r.new_name, (r.changed_on - DAY).days, r.years) for r in H.rebrands(t, "k", "name", "day", F.upper("name")).collect())
    assert changes == [(1, "Elm", "OAK", 400, 1), (1, "OAK", "Elm", 9, 1)]


def test_one_changed_row_is_found_in_one_leaf(spark):
    a = spark.range(300_000).select("id", (F.col("id") % 97).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("y"))
    b = a.withColumn("y", F.when(F.col("id") == 123_456, None).otherwise(F.col("y")))
    one, two = C.checksum_tree(a, ["id"], ["x", "y"]), C.checksum_tree(b.repartition(7), ["id"], ["x", "y"])
    assert C.differing_leaves(one, two).count() == 1
    assert [tuple(r) for r in C.differing_rows(a, b, ["id"], ["x", "y"], trees=(one, two)).collect()] == [(123_456, "differs")]
    assert C.differing_rows(a, a.repartition(3), ["id"], ["x", "y"]).count() == 0
    more = C.differing_rows(a.where("id > 2"), a.where("id < 299_998 or id is null".replace("_", "")), ["id"], ["x", "y"])
    assert sorted(map(tuple, more.collect())) == [(0, "only_b"), (1, "only_b"), (2, "only_b"), (299_998, "only_a"), (299_999, "only_a")]


def test_gate(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 10, "x" if i % 4 else None) for i in range(100)], "id int, a int, b string")
    rules = {"small": F.col("a") < 9, "named": F.col("b") == "x"}
    good, bad, counts = S.gated_write(rows, rules, str(tmp_path / "kept"), most=0.5)
    assert counts == {"checked": 100, "failed": 35 - 5 + 3, "failed_small": 10, "failed_named": 25} or counts["failed"] == bad.count()
    assert good.columns == rows.columns and good.count() + bad.count() == 100 and set(bad.columns) == {*rows.columns, "_why"}
    with pytest.raises(S.GateClosed) as e:
        S.gated_write(rows, rules, str(tmp_path / "gone"), most=0.1)
    assert e.value.counts["failed"] == counts["failed"] and not (tmp_path / "gone").exists()


@pytest.mark.parametrize("threshold", [0.82, 0.92, 0.99])
def test_jaro_winkler_join(spark, threshold):
    r = random.Random(6)
    words = ["".join(r.choices("abcde", k=r.randint(1, 9))) for _ in range(120)] + ["oak trust", "oak trusts", "the oak trust", "oka trust", "société élan", "societe elan", "x" * 30, "x" * 29 + "y"]
    rows = [(i, w) for i, w in enumerate(words)] + [(900, "oak trust"), (901, None), (902, "")]
    got = {(x.id_a, x.id_b): x.similarity for x in W.jaro_winkler_join(spark.createDataFrame(rows, "id long, name string"), threshold).collect()}
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1]]
    values = jaro_winkler_values([a[1] for a, _ in pairs], [b[1] for _, b in pairs])
    want = {(a[0], b[0]): v for (a, b), v in zip(pairs, values) if v >= threshold - 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
