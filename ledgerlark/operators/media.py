"""Adverse-media articles: terms, noise, severity, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import first_per_key


def score_articles(articles: DataFrame, terms: Sequence[str], noise: Sequence[str], as_of: str) -> DataFrame:
    """Articles that name a term, with terms and severity (0 to 100), one per link and headline.

    Columns: id, company, headline, body, link, provider, day. The age counts from ``as_of``.
    """
    low = F.lower(F.concat_ws(" ", "headline", "body"))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))
    rows = articles.withColumn("matched", found).where(F.size("matched") > 0)
    if noise:
        rows = rows.where(~F.exists(F.array(*map(F.lit, noise)), lambda t: F.lower("headline").contains(t)))
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    named = F.when(low.contains(F.lower("company")), 20).otherwise(0)
    fresh = F.when(age <= 365, 12).when(age <= 1095, 6).otherwise(0)
    score = F.lit(10) + named + F.least(F.size("matched") * 14, F.lit(50)) + F.when(F.col("provider") == "newsapi", 8).otherwise(0) + F.when(F.col("day").isNull(), 0).otherwise(fresh)
    rows = rows.withColumn("severity", F.least(F.greatest(score, F.lit(0)), F.lit(100))).withColumn("terms", F.array_join("matched", ","))
    key = rows.withColumn("_link", F.lower(F.coalesce("link", F.lit("")))).withColumn("_head", F.trim(F.regexp_replace(F.lower(F.coalesce("headline", F.lit(""))), r"\s+", " ")))
    return first_per_key(key, ["_link", "_head"], [F.col("id")]).drop("_link", "_head", "matched")
