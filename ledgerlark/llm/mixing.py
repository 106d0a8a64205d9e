"""Mixing sources to target weights by entropy balancing.

Each source has a token target. The document rates nearest to one in relative
entropy that meet it, none above ``most``, are min(most, exp(lambda * x)) with x
the document's size over its source's mean size. Newton's method on the convex
dual finds every source's lambda at once: each iteration is one aggregation
over the counts of (source, size), kept inside a bracket by bisection. Rates
are then rounded into whole copies with a random phase taken from the id's
hash; a common shift per source, found by counting thresholds in ever finer
buckets, brings the copies of each source up to its target, and the longest
documents that still fit fill what is left, until none does. The number of a row only parts rows that are equal.

Defined results: null or wordless text has size 0, takes nothing and changes
nothing; a null source is a source of its own, the last one; repeated rows are
documents of their own; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import release, written

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
CLOSE = 1e-7  # a target is met to this share of it
STEADY, GIVE_UP = 16, 400  # rounds of Newton steps alone; rounds that even halving the bracket can never need
_FINE, _STEPS = 30, (20, 10, 0)  # thresholds are counted in units of 2**-30, in buckets of 2**20, 2**10 and 1 of them


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.source.eqNullSafe(b.source)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; one row per source from here on.

    Targets are min(most * source_size, weight * level) with the level at which
    they add up to ``share`` of all sizes, found from running sums over the
    sources in the order in which they reach their limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)
    s = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("turn", F.row_number().over(rising))
    below = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (whole * share - below) / rest)
    level = F.min(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct("turn", "level"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level["level"], F.col("cap"))).alias("target"))


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.exp(F.least(lam * x, F.lit(math.log(most))))


def solve_rates(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, lam, mean): the dual variable of each source, by distributed Newton iterations."""
    counts = written(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    t = targets.where("target > 0")
    state = t.join(means, _same(t, means)).select(
        t.source, "target", "mean", (F.col("mean") * -60.0).alias("lo"), (F.col("mean") * math.log(most)).alias("hi"),
        F.when(F.col("target") >= F.col("source_size") * most * (1 - 1e-12), F.col("mean") * math.log(most)).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"), F.lit(False).alias("met"))
    state = written(state, "duals")
    for turn in range(GIVE_UP):
        # from here on every other step halves the bracket, which ends whatever the curve is like
        halve = F.lit(turn >= STEADY and turn % 2 == 1)
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), x, most)
        mass = F.col("n") * F.col("size") * rate
        j = counts.join(state, _same(counts, state)).select(state.source, "target", "mean", "lo", "hi", "lam", mass.alias("f"), F.when(F.col("lam") * x < math.log(most), mass * x).otherwise(0.0).alias("g"))
        sums = j.groupBy("source", "target", "mean", "lo", "hi", "lam").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
        over = F.col("f") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("f") - F.col("target")) / F.nullif(F.col("g"), F.lit(0.0))
        narrow = F.col("hi") - F.col("lo") <= F.greatest(F.abs("lam"), F.lit(1.0)) * 1e-14
        met = (F.abs(F.col("f") - F.col("target")) <= F.col("target") * CLOSE) | narrow
        moved = sums.select("source", "target", "mean", lo.alias("lo"), hi.alias("hi"), F.when(met, F.col("lam")).when(~halve & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2).alias("lam"), met.alias("met"))
        before, state = state, written(moved, "duals")
        release(before)
        if state.where("not met").isEmpty():
            break
    else:
        raise RuntimeError(f"rates not found in {GIVE_UP} rounds")
    # sums of doubles depend on their order in the last bits, reruns should not
    return state.select("source", F.round("lam", 11).alias("lam"), F.round("mean", 9).alias("mean"))


def _cutoffs(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cut): the last threshold up to which the copies do not exceed the target."""
    known = targets.select("source", F.col("target").alias("left"), F.lit(0).cast("long").alias("low"))
    wide = 64
    for shift in _STEPS:
        k = known
        inside = steps.join(k, _same(steps, k)).where((F.shiftright("at", wide) if wide < 63 else F.lit(0)) == F.col("low")).select(k.source, "left", F.shiftright("at", shift).alias("bucket"), "size")
        sums = inside.groupBy("source", "left", "bucket").agg(F.sum("size").alias("sum"))
        w = Window.partitionBy("source").orderBy("bucket")
        cum = sums.withColumn("through", F.sum("sum").over(w)).withColumn("before", F.col("through") - F.col("sum"))
        # the bucket in which the target is reached, or the last one
        all_of = Window.partitionBy("source")
        reach = F.min(F.when(F.col("through") >= F.col("left"), F.col("bucket"))).over(all_of)
        hit = cum.withColumn("hit", F.coalesce(reach, F.max("bucket").over(all_of))).where("bucket = hit")
        if shift:
            known = written(hit.select("source", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("low")), "cuts")
        else:
            fits = F.col("through") <= F.col("left") + 0.5
            known = hit.select("source", F.when(fits, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("cut"))
        wide = shift
    return known


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken): how often the mix takes each document.

    ``row_col`` names a column that numbers the rows of stored ``docs``; it is
    returned, so that rows which share an id can be told apart.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = written(docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), row.alias("row")), "sizes")
    targets = written(source_targets(rows, weights, share, most), "targets")
    duals = solve_rates(rows, targets, most)
    t = targets.join(duals, _same(targets, duals), "left").select(targets["*"], "lam", "mean")
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), _rate(F.col("lam"), F.col("size") / F.col("mean"), most)).otherwise(F.lit(0.0))
    phase = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("mix")), 11) / F.lit(float(1 << 53))
    rated = rows.join(t, _same(rows, t)).select(id_col, rows.source, "row", "size", "source_size", "target", rate.alias("rate"), phase.alias("phase"))
    # copy c is taken once rate + phase + shift reaches c
    at = lambda c: F.floor((c - F.col("rate") - F.col("phase") + most) * float(1 << _FINE)).cast("long")
    rated = written(rated.withColumn("at", F.array(*(at(F.lit(c)) for c in range(1, most + 1)))), "rated")
    steps = rated.where("rate > 0").select("source", "size", F.explode("at").alias("at"))
    cuts = written(_cutoffs(steps, targets.where("target > 0")), "cutoffs")
    joined = rated.join(cuts, _same(rated, cuts), "left")
    copies = F.when(F.col("rate") > 0, F.size(F.filter("at", lambda v: v <= F.col("cut")))).otherwise(0).cast("long")
    taken = joined.select(id_col, rated.source, "size", "source_size", "target", "rate", copies.alias("copies"), F.struct("size", F.xxhash64(id_col, F.lit("fill")).alias("h"), F.col(id_col).alias("i"), "row").alias("key"))
    taken = written(taken, "taken")
    while True:
        best = written(_best_fits(taken, most), "fits")
        if best.isEmpty():
            break
        before, taken = taken, written(_filled(taken, best, most), "taken")
        release(before, best)
    return taken.select(*([F.col("key.row").alias(row_col)] if row_col else []), id_col, "source", "size", "source_size", "target", F.round("rate", 9).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _best_fits(taken: DataFrame, most: int) -> DataFrame:
    """(of, room, best): sources that are short of their target, and the size of the longest document that still fits."""
    room = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("room")).where("room >= 1").withColumnRenamed("source", "of")
    open_ = taken.where((F.col("copies") < most) & (F.col("size") > 0)).groupBy("source", "size").agg(F.count("*").alias("n"))
    return open_.join(room, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") <= F.col("room")).groupBy("of", "room").agg(F.max("size").alias("best"))


def _filled(taken: DataFrame, best: DataFrame, most: int) -> DataFrame:
    """One more copy of as many documents of the size that fits best as there is room for, in each source that is short."""
    fits = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("best")) & (F.col("copies") < most)
    chosen = taken.join(best, fits).withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("key"))))
    chosen = chosen.where(F.col("turn") * F.col("size") <= F.col("room")).select(F.col("key").alias("more"))
    return taken.join(chosen, F.col("key").eqNullSafe(F.col("more")), "left").withColumn("copies", F.col("copies") + F.when(F.col("more").isNull(), 0).otherwise(1)).select(*taken.columns)
