"""First and latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. Catalyst plans this as a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def amendment_no(text: Column) -> Column:
    """Digits of an amendment number, so that 10 comes after 2."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def with_agreement_key(rows: DataFrame, bn: str = "bn", name: str = "recipient", row_id: str = "line_id") -> DataFrame:
    """Adds party_key and amend_no: a reference number alone does not name an agreement."""
    party = F.coalesce(F.col(bn), F.col(name), F.col(row_id).cast("string"))
    return rows.withColumn("party_key", party).withColumn("amend_no", amendment_no(F.col("amendment_number")))


AGREEMENT = ["ref_number", "party_key"]


def current_agreements(rows: DataFrame, date: str = "amendment_date", row_id: str = "line_id") -> DataFrame:
    """The latest amendment of each agreement: its value is the agreement's, amendments are cumulative."""
    return first_per_key(rows, AGREEMENT, [F.col("amend_no").desc_nulls_last(), F.col(date).desc_nulls_last(), F.col(row_id).desc()])


def original_agreements(rows: DataFrame, date: str = "amendment_date", row_id: str = "line_id") -> DataFrame:
    """The earliest row of each agreement that is no amendment and has a positive value."""
    rows = rows.where("not is_amendment and agreement_value > 0")
    return first_per_key(rows, AGREEMENT, [F.col("amend_no").asc_nulls_first(), F.col(date).asc_nulls_first(), F.col(row_id)])


def is_amendment(number: Column) -> Column:
    return number.isNotNull() & (number != "0")


def latest_name(rows: DataFrame, key: str, year: str, *ties: str) -> DataFrame:
    return first_per_key(rows, [key], [F.col(year).desc_nulls_last(), *(F.col(t) for t in ties)])
