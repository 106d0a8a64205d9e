"""Values that change over time: spells, what was valid on a day, and changes of name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 366


def spells(rows: DataFrame, key: str, value: str, day: str) -> DataFrame:
    """(key, value, first_day, last_day, valid_to): runs of days on which a key is seen with one value; valid to the day of the next value.

    A key that has two values on one day has the smaller; null keys, values and
    days are left out. Days are first one row a key, so a key with many rows is
    only as long as it has days.
    """
    r = rows.dropna(subset=[key, value, day]).groupBy(F.col(key).alias("key"), F.col(day).alias("day")).agg(F.min(value).alias("value"))
    by = Window.partitionBy("key").orderBy("day")
    fresh = r.withColumn("fresh", F.when(F.lag("value").over(by) == F.col("value"), 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(by)).groupBy("key", "run").agg(F.min("value").alias("value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    out = runs.withColumn("valid_to", F.lead("first_day").over(Window.partitionBy("key").orderBy("run")))
    return out.select(F.col("key").alias(key), F.col("value").alias(value), "first_day", "last_day", "valid_to")


def valid_on(rows: DataFrame, history: DataFrame, keys: Sequence[str], day: str, keep: Sequence[str], start: str = "valid_from", end: str = "valid_to", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``rows`` with the columns ``keep`` of the spell that holds their day; null where none does.

    Spells are cut into buckets of days, open ones up to the last day of the
    rows, and joined on key and bucket: an equi-join that can be dealt out,
    where a window over a key would be one task. Of spells that overlap the
    one that starts last counts. ``rows`` keep their number.
    """
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / bucket_days)
    last = F.lit(rows.agg(F.max(day)).first()[0]).cast("date")
    cut = history.withColumn("_to", F.coalesce(F.date_sub(end, 1), last)).where(F.col(start) <= F.col("_to"))
    cut = cut.withColumn("_bucket", F.explode(F.sequence(number(start), number("_to"))))
    names = [f"_h_{k}" for k in keys]
    h = cut.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), "_bucket", F.col(start).alias("_from"), "_to", F.struct(*keep).alias("_kept"))
    numbered = rows.withColumn("_bucket_of", number(day)).withColumn("_row", F.monotonically_increasing_id())
    on = (F.col("_bucket_of") == F.col("_bucket")) & F.col(day).between(F.col("_from"), F.col("_to"))
    for k, n in zip(keys, names):
        on &= F.col(k) == F.col(n)
    j = numbered.join(h, on, "left")
    best = j.groupBy("_row", *rows.columns).agg(F.max_by("_kept", F.col("_from")).alias("_kept"))
    return best.select(*rows.columns, *(F.col(f"_kept.{c}").alias(c) for c in keep))


def rebrands(rows: DataFrame, number: str, name: str, day: str, same: Column) -> DataFrame:
    """(number, old_name, new_name, changed_on, old_from, years): changes of name of one number, and the years that only the old name finds.

    ``same`` is a key of ``name`` (normalised): names of one key are no change.
    """
    keyed = rows.select(F.col(number).alias("number"), F.col(name).alias("name"), F.col(day).alias("day"), same.alias("key"))
    runs = spells(keyed, "number", "key", "day")
    shown = keyed.dropna(subset=["number", "key", "day"]).groupBy("number", "key").agg(F.min("name").alias("name"))
    by = Window.partitionBy("number").orderBy("first_day")
    told = runs.withColumns({"new_key": F.lead("key").over(by), "changed_on": F.lead("first_day").over(by)}).where("new_key is not null")
    old = shown.select("number", "key", F.col("name").alias("old_name"))
    new = shown.select("number", F.col("key").alias("new_key"), F.col("name").alias("new_name"))
    years = F.year("last_day") - F.year("first_day") + 1
    return told.join(old, ["number", "key"]).join(new, ["number", "new_key"]).select("number", "old_name", "new_name", "changed_on", F.col("first_day").alias("old_from"), years.alias("years"))
