"""Top-k, paging, interleaving and balanced choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; planned as a group limit on both sides of the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_rows(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """One page in a total order; bounds are clamped."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def vocabulary_rank(value: Column, words: Sequence[str]) -> Column:
    """Place of a word in a vocabulary, unknown words last."""
    found = F.array_position(F.array(*map(F.lit, words)), F.coalesce(value, F.lit("")))
    return F.when(found > 0, found).otherwise(len(words) + 1).cast("int")


def interleave(rows: DataFrame, group: str, order: Sequence[Column], most: int, place: str = "place") -> DataFrame:
    """Adds the turn in which a row comes when groups take turns, for the first ``most`` of each: a group limit; sort by it and the group."""
    return top_per_group(rows, [group], order, most, place)


def balanced(rows: DataFrame, dimensions: Sequence[Sequence[str]], order: Sequence[Column], k: int, id_col: str) -> DataFrame:
    """k rows that cover the dimensions: the best of each value of the first, of the second and so on, then the rest in order.

    The best of each value are group limits; no dimension is sorted whole. ``id_col`` names each row.
    """
    first = None
    for i, d in enumerate(dimensions):
        one = top_per_group(rows, d, order, 1, "_turn").select(id_col, F.lit(i).alias("_step"))
        first = one if first is None else first.unionByName(one)
    steps = first.groupBy(id_col).agg(F.min("_step").alias("_step"))
    ranked = rows.join(steps, id_col, "left").withColumn("coverage_step", F.coalesce("_step", F.lit(len(dimensions)))).drop("_step")
    return ranked.orderBy("coverage_step", *order).limit(k)
