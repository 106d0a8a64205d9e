"""Comparison of two stores by trees of checksums: only what lies in differing leaves is joined."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.store import written

BITS, STEP = 16, 4  # 65,536 leaves; a node has 16 children


def _leaf(keys: Sequence[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def _print(keys: Sequence[str], values: Sequence[str]) -> Column:
    """Checksum of a row that tells null from any value."""
    return F.xxhash64(*keys, *(x for v in values for x in (F.col(v), F.col(v).isNull())))


def checksum_tree(rows: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int = BITS) -> DataFrame:
    """(level, node, rows, sum): counts and sums of row checksums of each node, the leaves at level ``bits`` / 4 and the root at 0.

    One pass with partial sums makes the leaves; the other levels are made of
    them. Sums do not depend on order, so equal stores have equal trees however
    they are stored; a tree can be kept beside its store.
    """
    leaves = rows.select(_leaf(keys, bits).alias("node"), _print(keys, values).cast("decimal(38,0)").alias("h")).groupBy("node").agg(F.count("*").alias("rows"), F.sum("h").alias("sum"))
    leaves = written(leaves, "leaves")
    depth = bits // STEP
    levels = [leaves.groupBy(F.shiftrightunsigned("node", STEP * (depth - k)).alias("node")).agg(F.sum("rows").alias("rows"), F.sum("sum").cast("decimal(38,0)").alias("sum")).select(F.lit(k).alias("level"), "node", "rows", "sum") for k in range(depth)]
    return reduce(DataFrame.unionByName, levels, leaves.select(F.lit(depth).alias("level"), "node", "rows", F.col("sum").cast("decimal(38,0)").alias("sum")))


def differing_leaves(a: DataFrame, b: DataFrame, bits: int = BITS) -> DataFrame:
    """(node): leaves in which two trees differ, from the root down: only children of differing nodes are compared."""
    depth = bits // STEP
    at = None
    for k in range(depth + 1):
        side = lambda t, s: t.where(F.col("level") == k).select("node", F.col("rows").alias(f"rows_{s}"), F.col("sum").alias(f"sum_{s}"))
        x, y = side(a, "a"), side(b, "b")
        if at is not None:
            up = F.shiftrightunsigned("node", STEP)
            x, y = (t.join(at.withColumnRenamed("node", "up"), up == F.col("up"), "left_semi") for t in (x, y))
        same = F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("sum_a").eqNullSafe(F.col("sum_b"))
        at = written(x.join(y, "node", "full").where(~same).select("node"), "differing")
        if at.isEmpty():
            break
    return at


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int = BITS, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, status): only_a, only_b or differs, for rows in differing leaves; ``keys`` name rows, null keys are equal to one another.

    ``trees`` of stores that keep theirs spare the pass that makes them.
    """
    one, two = trees or (checksum_tree(a, keys, values, bits), checksum_tree(b, keys, values, bits))
    leaves = differing_leaves(one, two, bits)
    some = lambda t, s: t.withColumn("_leaf", _leaf(keys, bits)).join(leaves, F.col("_leaf") == F.col("node"), "left_semi").select(*(F.col(k).alias(f"{k}_{s}") for k in keys), _print(keys, values).alias(f"_{s}"))
    x, y = some(a, "a"), some(b, "b")
    on = reduce(lambda p, q: p & q, (F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys))
    j = x.join(y, on, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("differs")
    return j.select(*(F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in keys), status.alias("status"))
