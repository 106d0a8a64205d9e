"""Comparison of result sets and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def within_tolerance(x: Column, y: Column, absolute: float = 1, relative: float = 0.01) -> Column:
    """Equal for a reviewer: not both more than ``absolute`` and more than ``relative`` apart; null equals null."""
    gap = F.abs(x - y)
    scale = F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return F.coalesce((gap <= absolute) | (gap / scale <= relative), x.isNull() & y.isNull())


def typed_equal(x: Column, y: Column, kind: str) -> Column:
    """Equality of stored values: decimals to 1e-6, dates with any separator, null equals null."""
    if kind == "decimal":
        same = F.abs(x.try_cast("decimal(38,8)") - y.try_cast("decimal(38,8)")) <= 1e-6
    elif kind == "date":
        same = F.regexp_replace(F.left(x.cast("string"), F.lit(10)), "/", "-") == F.regexp_replace(F.left(y.cast("string"), F.lit(10)), "/", "-")
    else:
        same = F.trim(x.cast("string")) == F.trim(y.cast("string"))
    return F.coalesce(same, x.isNull() & y.isNull())


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each key of either side with its status: match, differs, only_a, only_b, and the values that differ."""
    x = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("_a"))
    y = b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("_b"))
    bad = F.array_compact(F.array(*(F.when(~within_tolerance(F.col(f"a_{v}").cast("double"), F.col(f"b_{v}").cast("double")), F.lit(v)) for v in values)))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.size(bad) > 0, "differs").otherwise("match")
    return x.join(y, list(keys), "full").withColumn("status", status).withColumn("differing", F.array_join(bad, ",")).drop("_a", "_b")


def verdict(difference: DataFrame) -> DataFrame:
    """Counts of a ``diff`` with overlap ratio: pass if all match, warning from nine tenths of overlap, else fail."""
    n = lambda s: F.count_if(F.col("status") == s)
    one = difference.agg(n("match").alias("matched"), n("differs").alias("differing"), n("only_a").alias("only_a"), n("only_b").alias("only_b"))
    overlap = F.try_divide((F.col("matched") + F.col("differing")).cast("double"), F.col("matched") + F.col("differing") + F.col("only_a") + F.col("only_b"))
    clean = (F.col("differing") + F.col("only_a") + F.col("only_b")) == 0
    return one.withColumn("overlap", F.round(overlap, 6)).withColumn("verdict", F.when(clean, "pass").when((F.col("overlap") >= 0.9) & (F.col("differing") == 0), "warning").otherwise("fail"))


def profile(rows: DataFrame, key: Sequence[str], numbers: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """One row of what a reload must reproduce: keys, non-null counts and sums, boolean counts, as (measure, value)."""
    values = [("keys", F.countDistinct(F.struct(*key)).cast("double")), ("rows", F.count("*").cast("double"))]
    values += [(f"filled:{c}", F.count(c).cast("double")) for c in numbers] + [(f"sum:{c}", F.sum(F.col(c).cast("decimal(28,4)")).cast("double")) for c in numbers]
    values += [(f"true:{c}", F.count_if(F.col(c)).cast("double")) for c in flags]
    one = rows.agg(*(v.alias(f"m{i}") for i, (_, v) in enumerate(values)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"m{i}").alias("value")) for i, (n, _) in enumerate(values)))).alias("x")).select("x.*")


def reload_check(source: DataFrame, store: DataFrame) -> DataFrame:
    """Two profiles by measure: counts within max(5, 0.01 %), sums within 1e-4 or 1."""
    j = source.select("measure", F.col("value").alias("source_value")).join(store.select("measure", F.col("value").alias("store_value")), "measure", "full")
    gap = F.abs(F.coalesce("source_value", F.lit(0.0)) - F.coalesce("store_value", F.lit(0.0)))
    sums = F.col("measure").startswith("sum:")
    room = F.when(sums, F.greatest(F.lit(1.0), F.abs("source_value") * 1e-4)).otherwise(F.greatest(F.lit(5.0), F.abs("source_value") * 1e-4))
    return j.withColumn("ok", F.coalesce(gap <= room, F.lit(False)))


def unmapped(source: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(measure, value): how many keys of the source the store lacks."""
    return only_in(source, store, keys).select(*keys).distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("unmapped").alias("measure"), "value")


def typed_audit(source: DataFrame, store: DataFrame, keys: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(field, differing, checked) over the rows that both sides have; ``kinds``: how each field is compared."""
    j = source.select(*keys, *(F.col(c).alias(f"s_{c}") for c in kinds)).join(store.select(*keys, *(F.col(c).alias(f"t_{c}") for c in kinds)), list(keys))
    tests = F.array(*(F.struct(F.lit(c).alias("field"), typed_equal(F.col(f"s_{c}"), F.col(f"t_{c}"), kind).alias("same")) for c, kind in kinds.items()))
    return j.select(F.explode(tests).alias("x")).groupBy("x.field").agg(F.count_if(~F.col("x.same")).alias("differing"), F.count("*").alias("checked"))
