"""Names looked up in several sources, and cited names against the registry."""

import pytest

from ledgerlark.operators import finder as D
from ledgerlark.operators import similarity as M


def test_best_per_source(spark):
    asked = spark.createDataFrame([(1, " oak trust"), (2, "Elm Socety"), (3, "zz"), (4, None), (5, ""), (6, "ab")], "id long, name string")
    known = spark.createDataFrame([("p", "Oak Trust"), ("p", "Oak Trusts"), ("q", "Oak Trusts"), ("q", "Elm Society"), ("q", "ELM SOCIETY "), ("p", None), ("r", "aB"), ("r", "abc")], "source string, name string")
    got = {(r.id, r.source): (r.matched_name, r.confidence, r.method) for r in D.best_per_source(asked, known).collect()}
    assert got[1, "p"] == ("Oak Trust", 1.0, "exact") and got[6, "r"] == ("aB", 1.0, "exact")
    assert got[1, "q"] == ("Oak Trusts", 0.9, "levenshtein") and got[2, "q"] == ("ELM SOCIETY ", 0.91, "levenshtein")
    assert set(got) == {(1, "p"), (1, "q"), (2, "q"), (6, "r")}


def test_cited_names(spark):
    rows = [("000000000RR0001", "x", 5), ("120000001RC1", "Oak", 5), ("120000009RR0001", "Oak", 1), (" 120000001RR0001", "The Oak Trust", 2), ("120000001RR0001", "The Oak Trust", None), ("120000001RR0001", "Something else", 4), (None, "x", 1), ("1", " ", 1)]
    registry = [("120000001RR0001", "Old name", 1999), ("120000001RR0001", "Oak Trust", 2004)]
    got = {(r.number, r.name): r for r in D.cited_names(spark.createDataFrame(rows, "number string, name string, amount long"), spark.createDataFrame(registry, "number string, legal_name string, year int")).collect()}
    assert {k: v.category for k, v in got.items()} == {
        ("000000000RR0001", "x"): "PLACEHOLDER_BN", ("120000001RC1", "Oak"): "MALFORMED_BN", ("120000009RR0001", "Oak"): "UNREGISTERED_BN",
        ("120000001RR0001", "The Oak Trust"): "MINOR_VARIANT", ("120000001RR0001", "Something else"): "NAME_MISMATCH",
    }
    fits = got["120000001RR0001", "The Oak Trust"]
    assert (fits.citations, fits.total, fits.similarity, fits.canonical_name) == (2, 2, 1.0, "Oak Trust") and got["120000001RC1", "Oak"].defect == "02_RC_payroll_program"


def test_asked_names_do_not_meet_each_other(spark, monkeypatch):
    seen, across = [], D.M._across
    monkeypatch.setattr(D.M, "_across", lambda s, r, meet: seen.append(across(s, r, meet)) or seen[-1])
    asked = spark.createDataFrame([(i, f"a{i:03} group") for i in range(200)] + [(900, "oak trust of the elms")], "id long, name string")
    known = spark.createDataFrame([("p", "oak trust of the elm"), ("p", "ash")], "source string, name string")
    got = D.best_per_source(asked, known).collect()
    assert [(r.id, r.matched_name, r.method) for r in got] == [(900, "oak trust of the elm", "levenshtein")]
    assert len(seen) == 3 and sum(x.count() for x in seen) < 10  # 200 names with one last word were 19,900 pairs to compare


@pytest.mark.parametrize("join", ["trigram_join", "levenshtein_match"])
def test_between_keeps_the_pairs_of_both_sides(spark, join):
    words = [f"{a}{b} {c} trust" for a in ("oak", "elm", "asher") for b in ("s", "", "es") for c in ("of", "off", "north")] + ["ab", "abc", "abd", "oak", "oaks"]
    rows = spark.createDataFrame([(i, w, i % 2 == 0, i % 3 != 0) for i, w in enumerate(words)], "id long, name string, x boolean, y boolean")
    run = lambda **k: {(r.id_a, r.id_b) for r in (M.trigram_join(rows, 0.5, **k) if join == "trigram_join" else M.levenshtein_match(rows, [], 2, **k)).collect()}
    both = lambda i, j: (i % 2 == 0 and j % 3 != 0) or (j % 2 == 0 and i % 3 != 0)
    want = {p for p in run() if both(*p)}
    assert len(want) > 20 and run(between=("x", "y")) == want
