"""Aggregations beyond a plain group-by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(rows: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*(v.alias(k) for k, v in values.items()))


def count_where(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def sum_where(test: Column, value: Column) -> Column:
    return F.sum(F.when(test, value))


def distinct_list(value: Column, sep: str = "|", n: int | None = None) -> Column:
    """Distinct values in order as one text, nulls left out; at most ``n`` if given."""
    found = F.array_sort(F.collect_set(value))
    return F.array_join(F.slice(found, 1, n) if n else found, sep)


def by_and_overall(rows: DataFrame, keys: Sequence[str], period: str, values: dict[str, Column], names: tuple[str, str] = ("by_fiscal_year", "all_years")) -> DataFrame:
    """Rows per key and period and rows over all periods, told apart by aggregation_type, in one pass."""
    sets = [[*keys, period], list(keys)]
    cols = [F.col(c) for c in (*keys, period)]
    made = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping(period).alias("_all"), *(v.alias(k) for k, v in values.items()))
    return made.withColumn("aggregation_type", F.when(F.col("_all") == 1, names[1]).otherwise(names[0])).drop("_all")


def with_shares(rows: DataFrame, value: str, within: Sequence[str], share: str = "share", total: str = "total") -> DataFrame:
    """Adds the total of a group and each row's share of it: an aggregate joined back, so that a large group is not one task."""
    sums = rows.groupBy(*within).agg(F.sum(value).alias(total))
    return rows.join(sums, list(within)).withColumn(share, F.col(value).cast("double") / F.nullif(F.col(total).cast("double"), F.lit(0.0)))


def with_grand_total(rows: DataFrame, value: str, share: str = "share", total: str = "total") -> DataFrame:
    """Adds the grand total by a join with one row."""
    one = rows.agg(F.sum(value).alias(total))
    return rows.crossJoin(F.broadcast(one)).withColumn(share, F.col(value).cast("double") / F.nullif(F.col(total).cast("double"), F.lit(0.0)))


def concentration(rows: DataFrame, cell: Sequence[str], entity: str, value: str, min_value: float = 0, min_entities: int = 1) -> DataFrame:
    """Per cell: entities, dollars, HHI (0 to 1), CR4, top share, effective competitors and the five largest entities."""
    totals = rows.groupBy(*cell, entity).agg(F.sum(value).alias("dollars")).where("dollars > 0")
    shares = with_shares(totals, "dollars", cell, total="cell_dollars")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("dollars").desc(), F.col(entity)))
    ranked = shares.withColumn("rank", rank)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", entity)))), lambda x: x[entity]), "; ")
    made = ranked.groupBy(*cell).agg(
        F.count("*").alias("entity_count"), F.max("cell_dollars").alias("total_dollars"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.when(F.col("rank") <= 4, F.col("share")).otherwise(0.0)).alias("cr4"),
        F.max("share").alias("top_share"), F.max_by(entity, F.col("dollars")).alias("_top"), F.sum("share").alias("share_sum"), top.alias("top_entities"))
    made = made.drop("_top").withColumn("effective_competitors", 1 / F.nullif(F.col("hhi"), F.lit(0.0)))
    return made.where((F.col("total_dollars") >= min_value) & (F.col("entity_count") >= min_entities))


def concentration_ok(tolerance: float = 0.001) -> Column:
    """Invariants of a concentration row."""
    unit = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1 + 1e-9)
    return (F.abs(F.col("share_sum") - 1) <= tolerance) & unit("hhi") & unit("cr4") & unit("top_share") & (F.col("effective_competitors") >= 1 - 1e-9)


def hhi_level(hhi: Column) -> Column:
    """Level of an index on the scale to 10,000."""
    return F.when(hhi > 2500, "HIGH").when(hhi > 1500, "MODERATE").otherwise("LOW")


def null_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, blanks and share filled. One pass over the data."""
    filled = [F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(f"f{i}") for i, c in enumerate(columns)]
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)]
    one = rows.agg(F.count("*").alias("rows"), *filled, *nulls)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"f{i}").alias("filled")) for i, c in enumerate(columns))))
    return one.select("rows", each.alias("x")).select("x.column_name", "rows", "x.nulls", "x.filled", F.round(F.try_divide(F.col("x.filled") * 100.0, F.col("rows")), 4).alias("filled_pct"))


def growth_parts(n0: Column, p0: Column, n1: Column, p1: Column) -> dict[str, Column]:
    """Change of n * p as volume, value and interaction; they add up to it."""
    return {"volume_effect": (n1 - n0) * p0, "value_effect": n0 * (p1 - p0), "interaction_effect": (n1 - n0) * (p1 - p0)}
