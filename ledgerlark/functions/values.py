"""Dates, numbers, codes and scores as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(date: Column) -> Column:
    """Label YYYY-YYYY of the fiscal year that starts on 1 April."""
    first = F.year(date) - F.when(F.month(date) >= 4, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))


def fiscal_quarter(date: Column) -> Column:
    """1 for April to June, 4 for January to March."""
    return F.when(F.month(date) >= 4, F.floor((F.month(date) - 4) / 3) + 1).otherwise(4).cast("int")


def years_between(first: Column, last: Column) -> Column:
    return F.floor(F.months_between(last, first) / 12).cast("int")


def parse_date(text: Column) -> Column:
    """ISO, slashed and US dates with or without a time, and spreadsheet serials; null outside 1800 to 2100."""
    t = F.trim(text)
    head = F.substring_index(t, " ", 1)
    serial = F.when(t.rlike(r"^[0-9]{4,6}(\.[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.cast("double")).cast("int")))
    found = F.coalesce(serial, *(F.try_to_date(F.left(head, F.lit(10)), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd")), F.try_to_date(head, "M/d/yyyy"))
    return F.when(F.year(found).between(1800, 2100), found)


def parse_decimal(text: Column, kind: str = "decimal(18,2)") -> Column:
    """Amount from text with currency signs, separators and spaces; null if it is no number."""
    return F.regexp_replace(text, r"[$,\s]", "").try_cast(kind)


def parse_int(text: Column) -> Column:
    """Whole part of a number in text."""
    n = F.regexp_replace(text, r"[$,\s]", "").try_cast("decimal(38,6)")
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")


def parse_bool(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.isin("Y", "YES", "TRUE", "T", "1", "X"), True).when(t.isin("N", "NO", "FALSE", "F", "0"), False)


def two_letter_code(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def blank_to_null(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t != "", t)


def split_list(text: Column, sign: str = r"[|;]") -> Column:
    return F.filter(F.transform(F.split(text, sign), lambda x: F.trim(x)), lambda x: x != "")


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 0))


def banded(value: Column, bands: Sequence[tuple[float, int]], otherwise: int = 0, at_most: bool = False) -> Column:
    """Points of the first band whose limit the value reaches (``at_most``: does not exceed)."""
    found = None
    for limit, points in bands:
        test = value <= limit if at_most else value >= limit
        found = F.when(test, points) if found is None else found.when(test, points)
    return found.otherwise(otherwise)


def flag(test: Column, points: int) -> Column:
    """Points where the test holds; unknown is no."""
    return F.when(test, points).otherwise(0)


def total(parts: Sequence[Column], cap: int | None = None) -> Column:
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    return (F.least(s, F.lit(cap)) if cap is not None else s).cast("int")


def reasons(*named: tuple[Column, str]) -> Column:
    """Texts of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(text)) for test, text in named)))


def near_threshold(value: Column, thresholds: Sequence[float] = (25_000, 75_000, 100_000), share: float = 0.95) -> Column:
    """Whether the value is just below one of the thresholds."""
    return F.exists(F.array(*map(F.lit, thresholds)), lambda t: (value >= t * share) & (value < t))


def ratio(a: Column, b: Column) -> Column:
    """Quotient as a double, null where the divisor is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def sampled(key: Column, one_in: int, salt: str = "") -> Column:
    """The same rows in every run and in any engine: one key in so many, by the first eight digits of its md5."""
    return F.conv(F.left(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long") % one_in == 0
