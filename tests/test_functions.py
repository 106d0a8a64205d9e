"""Golden cases of names, numbers, dates and scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.functions import values as V


def one(spark, column, *values):
    """The column over one row whose columns are a, b, c ..."""
    names = "abcdefgh"[: len(values)]
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("$3,138.00", 3138.0), ("$ 1,000", 1000.0), ("abc", None), (None, None), ("-2.5", -2.5)])
def test_decimals(spark, text, want):
    got = one(spark, V.parse_decimal(F.col("a")), text)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("text, want", [("1979/06/18", dt.date(1979, 6, 18)), ("6/22/2015 12:00:00 AM", dt.date(2015, 6, 22)), ("0001-01-01", None), ("3000-01-01", None), ("43890", dt.date(2020, 2, 29)), ("2020-13-01", None), ("", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, V.parse_date(F.col("a")), text) == want


@pytest.mark.parametrize("text, want", [("on", "ON"), ("ONT", None), ("12", None), (None, None)])
def test_codes(spark, text, want):
    assert one(spark, V.two_letter_code(F.col("a")), text) == want


@pytest.mark.parametrize("text, want", [("O'Brien & Sons, Inc.", "O BRIEN SONS INC"), ("The Shelter Society", "SHELTER SOCIETY"), ("Alpha | Alpha en français", "ALPHA"), ("Beta Ltd O/A Gamma", "BETA LTD"), ("Name (The)", "NAME"), (None, "")])
def test_canonical_names(spark, text, want):
    assert one(spark, N.norm_name(F.col("a")), text) == want


@pytest.mark.parametrize("text, want", [("118814391RR0001", "118814391"), (" 118814391 RR0001", "118814391"), ("12345", None), ("000123456", None), ("100000000", None), (None, None)])
def test_number_roots(spark, text, want):
    assert one(spark, N.bn_root(F.col("a")), text) == want


@pytest.mark.parametrize("text, want", [("Org English | Org French", ["Org English", "Org French"]), ("The Society, .", ["The Society"]), ("Old Co trade name of New Co", ["Old Co", "New Co"]), ("Plain", ["Plain"]), ("A1 Farms DBA B2 Farms", ["A1 Farms", "B2 Farms"])])
def test_alternate_names(spark, text, want):
    assert one(spark, N.alternate_names(F.col("a")), text) == want


def test_token_measures(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    got = one(spark, N.token_overlap(words("BOYLE STREET SERVICE"), words("BOYLE STREET EDUCATION")), "x")
    assert abs(got - 2 / 3) < 1e-9 and one(spark, N.token_overlap(words("SERVICE"), words("SERVICES")), "x") == 1
    assert one(spark, N.token_jaccard(F.col("a"), F.col("b")), "A B C", "A B C") == 1 and one(spark, N.token_jaccard(F.col("a"), F.col("b")), "A B", "C D") == 0


def test_trigrams(spark):
    assert set(one(spark, N.trigrams(F.col("a")), "Cat!")) == {"  c", " ca", "cat", "at "}
    assert one(spark, N.trigram_similarity(F.col("a"), F.col("b")), "word", "two words") == pytest.approx(4 / 11)
    assert one(spark, N.trigram_similarity(F.col("a"), F.col("b")), "", "") is None


def test_lists_and_blanks(spark):
    assert one(spark, V.split_list(F.col("a")), " one |two; ;three") == ["one", "two", "three"]
    assert one(spark, V.blank_to_null(F.col("a")), "  ") is None and one(spark, V.blank_to_null(F.col("a")), " a \n b ") == "a b"


def test_scores(spark):
    bands = [(100, 3), (10, 2)]
    assert [one(spark, V.banded(F.lit(x), bands, 1), "x") for x in (100, 99, 9)] == [3, 2, 1]
    assert one(spark, V.near_threshold(F.lit(24_000)), "x") and not one(spark, V.near_threshold(F.lit(25_000)), "x")
    assert one(spark, V.reasons((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")), "x") == ["a"]
    assert one(spark, V.fiscal_year(F.lit("2020-03-31").cast("date")), "x") == "2019-2020" and one(spark, V.fiscal_quarter(F.lit("2020-04-01").cast("date")), "x") == 1
