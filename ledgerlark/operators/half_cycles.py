"""Simple cycles of up to eight hops by half paths that meet in the middle.

A cycle of k hops through its root is a path of ceil(k / 2) edges from the root
and one of floor(k / 2) edges back to it, which meet in one node and share no
other. The root is the node of the highest degree (ties: the smallest), so each
cycle is found once, and a hub begins paths but is never inside one. Paths are
carried for at most four hops, and only inside a strong component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import graph as G
from ledgerlark.sources.store import release, written

MOST = 8


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges inside strong components, with the place of both ends in the order of roots: (-degree, node)."""
    parts = written(G.strong_components(edges.select("src", "dst")), "parts")
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}"))
    inner = edges.join(of("src"), "src").join(of("dst"), "dst").where("in_src = in_dst and src <> dst").select(*edges.columns)
    ends = inner.select(F.col("src").alias("node")).unionByName(inner.select(F.col("dst").alias("node"))).groupBy("node").agg((-F.count("*")).alias("degree"))
    place = lambda end: ends.select(F.col("node").alias(end), F.struct("degree", F.col("node").alias("node")).alias(f"{end}_place"))
    return written(inner.join(place("src"), "src").join(place("dst"), "dst"), "ranked")


def _within(window: int | None) -> Column:
    return F.lit(True) if window is None else F.col("max_year") - F.col("min_year") <= window


def _halves(edges: DataFrame, longest: int, forward: bool, window: int | None) -> list[DataFrame]:
    """Paths of 1 to ``longest`` edges from a root to an end (forward) or from an end to a root, over nodes that come after it.

    ``inner`` holds the nodes between root and end in the order of the cycle.
    """
    root, end = ("src", "dst") if forward else ("dst", "src")
    first = edges.where(F.col(f"{root}_place") < F.col(f"{end}_place")).select(
        F.col(f"{root}_place").alias("root"), F.col(end).alias("end"), F.array().cast(f"array<{edges.schema[end].dataType.simpleString()}>").alias("inner"),
        F.col("total_amt").alias("bottleneck"), F.col("total_amt").alias("total_flow"), "min_year", "max_year").where(_within(window))
    found = [written(first, "half")]
    step = edges.select(F.col(root).alias("end"), F.col(end).alias("to"), F.col(f"{end}_place").alias("place"), F.col("total_amt").alias("amt"), F.col("min_year").alias("y0"), F.col("max_year").alias("y1"))
    for _ in range(longest - 1):
        j = found[-1].join(step, "end").where((F.col("place") > F.col("root")) & ~F.array_contains("inner", F.col("to")))
        inner = F.array_append("inner", F.col("end")) if forward else F.array_prepend("inner", F.col("end"))
        longer = j.select("root", F.col("to").alias("end"), inner.alias("inner"), F.least("bottleneck", "amt").alias("bottleneck"), (F.col("total_flow") + F.col("amt")).alias("total_flow"), F.least("min_year", "y0").alias("min_year"), F.greatest("max_year", "y1").alias("max_year"))
        found.append(written(longer.where(_within(window)), "half"))
    return found


def _meet(there: DataFrame, back: DataFrame, window: int | None) -> DataFrame:
    b = back.select("root", "end", *(F.col(c).alias(f"{c}_b") for c in ("inner", "bottleneck", "total_flow", "min_year", "max_year")))
    j = there.join(b, ["root", "end"]).where(~F.arrays_overlap("inner", "inner_b"))
    around = F.concat(F.array(F.col("root.node")), "inner", F.array("end"), "inner_b")
    met = j.select(around.alias("around"), F.least("bottleneck", "bottleneck_b").alias("bottleneck"), (F.col("total_flow") + F.col("total_flow_b")).alias("total_flow"), F.least("min_year", "min_year_b").alias("min_year"), F.greatest("max_year", "max_year_b").alias("max_year"))
    at = F.array_position("around", F.array_min("around")).cast("int")
    path = F.concat(F.slice("around", at, F.size("around")), F.slice("around", F.lit(1), at - 1))
    return met.where(_within(window)).withColumn("path", path).select("path", F.array_join("path", ">").alias("path_key"), F.size("path").alias("hops"), "bottleneck", "total_flow", "min_year", "max_year")


def cycles_by_halves(edges: DataFrame, most: int, window: int | None = None, carried: list[int] | None = None) -> DataFrame:
    """Simple cycles of 2 to ``most`` hops, as ``graph.all_cycles`` gives them. ``carried`` takes the number of half paths of each step.

    Null ends are no nodes; of repeated edges each makes cycles of its own;
    without a cycle the result is empty.
    """
    if not 2 <= most <= MOST:
        raise ValueError(f"2 to {MOST} hops")
    kept = written(edges.dropna(subset=["src", "dst"]).select("src", "dst", "total_amt", "min_year", "max_year"), "edges")
    ranked = _ranked(kept)
    release(kept)
    there, back = _halves(ranked, -(-most // 2), True, window), _halves(ranked, most // 2, False, window)
    if carried is not None:
        carried += [half.count() for half in (*there, *back)]
    found = None
    for k in range(2, most + 1):
        met = _meet(there[-(-k // 2) - 1], back[k // 2 - 1], window)
        found = met if found is None else found.unionByName(met)
    return found
