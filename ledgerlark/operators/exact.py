"""Exact order statistics of groups of any size, and payments matched to their reversals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.sources.store import release, written

BUCKETS = 1024


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def values_at_ranks(rows: DataFrame, asks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``asks`` (keys, ask, rank from 0) with the value of that rank in its group.

    Values are counted in buckets between the least and the greatest that a
    rank can still be; the bucket that holds it is looked at again, until it
    holds one value. Each round is one aggregation with partial sums, so no
    task holds a group, and the bounds are values that occur, so rounds end.
    """
    x = F.col(value).cast("double")
    held = written(rows.select(*keys, x.alias("x")).where(x.isNotNull() & ~F.isnan(x)), "values")
    ends = held.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = written(asks.join(ends, _same(asks, ends, keys)).select(*(asks[k] for k in keys), "ask", F.col("rank").alias("left"), "lo", "hi"), "ranks")
    while not state.where("lo < hi").isEmpty():
        open_ = state.where("lo < hi").select(*(F.col(k).alias(f"_{k}") for k in keys), "ask", "left", "lo", "hi")
        met = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True)) & F.col("x").between(F.col("lo"), F.col("hi"))
        half = F.col("hi") / 2 - F.col("lo") / 2  # the whole may be more than a double holds
        at = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / half * BUCKETS), F.lit(BUCKETS - 1))
        # a range too narrow to be divided is told apart by its lower end
        at = F.when(half > 0, at).otherwise(F.when(F.col("x") > F.col("lo"), 1).otherwise(0))
        group = [*(f"_{k}" for k in keys), "ask", "left"]
        counts = held.join(open_, met).groupBy(*group, at.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        through = counts.withColumn("through", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")))
        hit = through.where((F.col("left") < F.col("through")) & (F.col("left") >= F.col("through") - F.col("n")))
        moved = hit.select(*(F.col(f"_{k}").alias(k) for k in keys), "ask", (F.col("left") - F.col("through") + F.col("n")).alias("left"), "lo", "hi")
        before, state = state, written(state.where("lo = hi").unionByName(moved), "ranks")
        release(before)
    return state.select(*keys, "ask", F.col("lo").alias("value"))


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with the interpolated percentile of each name in ``shares``; nulls and NaN do not count.

    A group without a value has no row; a null key is a group of its own; ties
    and repeated rows count as often as they stand.
    """
    x = F.col(value).cast("double")
    sizes = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.count("*").alias("n"))
    rank = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    both = F.array(*(F.struct(F.lit(f"{name}{end}").alias("ask"), f(rank(p)).cast("long").alias("rank")) for name, p in shares.items() for end, f in (("_lo", F.floor), ("_hi", F.ceil))))
    sizes = written(sizes, "sizes")
    asks = sizes.select(*keys, F.explode(both).alias("a")).select(*keys, "a.ask", "a.rank")
    found = values_at_ranks(rows, asks, keys, value)
    pick = lambda ask: F.max(F.when(F.col("ask") == ask, F.col("value")))
    wide = found.groupBy(*keys).agg(*(pick(f"{n}{e}").alias(f"{n}{e}") for n in shares for e in ("_lo", "_hi")))
    j = wide.join(sizes, _same(wide, sizes, keys)).select(*(wide[k] for k in keys), "n", *(c for c in wide.columns if c not in keys))
    part = lambda p: rank(p) - F.floor(rank(p))
    return j.select(*keys, *((F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part(p)).alias(n) for n, p in shares.items()))


def matched_reversals(payments: DataFrame, keys: Sequence[str], amount: str = "amount", order: Sequence[str] = ("day", "id"), id_col: str = "id") -> DataFrame:
    """(keys, amount, id, reversed_by): each payment with the later payment of its negative that takes it back, one to one.

    In the order of a group of equal absolute amounts a negative takes back the
    first payment before it that is not yet taken back. It finds none where the
    running sum of signs reaches a new low; the others are, in their order, the
    partners of the positives in theirs. Zero and null amounts match nothing.
    """
    size = F.abs(amount)
    rows = payments.where(F.col(amount) != 0).select(*keys, size.alias("amount"), F.signum(amount).cast("int").alias("sign"), *dict.fromkeys([*order, id_col]))
    by = Window.partitionBy(*keys, "amount").orderBy(*order)
    run = rows.withColumn("run", F.sum("sign").over(by))
    low = run.withColumn("low", F.least(F.lit(0), F.min("run").over(by.rowsBetween(Window.unboundedPreceding, -1))))
    told = low.where((F.col("sign") > 0) | (F.col("run") >= F.coalesce("low", F.lit(0))))
    placed = told.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "amount", "sign").orderBy(*order)))
    one = placed.where("sign > 0").select(*keys, "amount", "place", F.col(id_col).alias("id"))
    other = placed.where("sign < 0").select(*keys, "amount", "place", F.col(id_col).alias("reversed_by"))
    j = one.join(other, _same(one, other, [*keys, "amount"]) & (one["place"] == other["place"]))
    return j.select(*(one[c] for c in [*keys, "amount"]), "id", "reversed_by")
