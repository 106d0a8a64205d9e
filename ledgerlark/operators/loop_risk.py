"""Risk score of the members of gift loops: one number from 0 to 30."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import scores as S
from ledgerlark.sources.store import written

MOST = 30
TRIPS = [(5, 4), (3, 3), (1, 2)]  # round trips and their points


def round_trips(members: DataFrame, yearly: DataFrame, symmetry: float = 0.5) -> DataFrame:
    """(node, same_year, adjacent_year, multi_hop, persistent): money that goes out to the next of a loop and comes back from the one before.

    ``members``: (node, hops, sends_to, receives_from), a row per loop;
    ``yearly``: (src, dst, year, amount) of material size. A gift out is met in
    its own year, or else in the next, by a gift in of more than ``symmetry`` of
    the larger of both. Loops of three hops and more count as multi-hop;
    persistent is a pair of partners that is met in two years.
    """
    ends = members.groupBy("node", "hops", "sends_to", "receives_from").agg(F.count("*").alias("loops"))
    out = yearly.select(F.col("src").alias("node"), F.col("dst").alias("sends_to"), "year", F.col("amount").alias("out"))
    back = lambda apart, name: yearly.select(F.col("dst").alias("node"), F.col("src").alias("receives_from"), (F.col("year") - apart).alias("year"), F.col("amount").alias(name))
    trips = ends.join(out, ["node", "sends_to"])
    # the partner gives at all, as it does on the loop within the years looked at
    trips = trips.join(back(0, "now"), ["node", "receives_from", "year"], "left").join(back(1, "later"), ["node", "receives_from", "year"], "left")
    near = lambda c: F.coalesce(V.ratio(F.least("out", c), F.greatest("out", c)) > symmetry, F.lit(False)) & F.col(c).isNotNull()
    t = trips.select("*", near("now").alias("same"), (near("later") & ~near("now")).alias("next"))
    each = t.groupBy("node", "sends_to", "receives_from").agg(
        F.sum(F.when(F.col("same"), F.col("loops")).otherwise(0)).alias("sy"), F.sum(F.when(F.col("next"), F.col("loops")).otherwise(0)).alias("ay"),
        F.sum(F.when((F.col("same") | F.col("next")) & (F.col("hops") >= 3), F.col("loops")).otherwise(0)).alias("mh"), F.countDistinct(F.when(F.col("same") | F.col("next"), F.col("year"))).alias("years"))
    return each.groupBy("node").agg(F.sum("sy").alias("same_year"), F.sum("ay").alias("adjacent_year"), F.sum("mh").alias("multi_hop"), (F.max("years") >= 2).alias("persistent"))


def loop_risk(members: DataFrame, yearly: DataFrame, filings: DataFrame, shared: DataFrame, associated: DataFrame | None = None) -> DataFrame:
    """(node, circular_points, financial_points, temporal_points, score) of every member of a loop.

    ``filings``: the latest of each node (node, revenue, spending, program,
    overhead, gifts_in, gifts_out, pay); ``shared`` and ``associated``: (node)
    with shared people and with declared ties. Circular sums are the smaller of
    what goes out to and comes in from partners on loops, each gift once.
    """
    m = written(members.select("node", "hops", "sends_to", "receives_from"), "members")
    flag = lambda rows, name: rows.select("node").distinct().withColumn(name, F.lit(True))
    flows = S.circular_flows(m, yearly)
    j = m.select("node").distinct().join(flows, "node", "left").join(round_trips(m, yearly), "node", "left").join(filings, "node", "left").join(flag(shared, "people"), "node", "left")
    j = j.join(flag(associated, "ties"), "node", "left") if associated is not None else j.withColumn("ties", F.lit(False))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    circular = S.circular_points(z("partners"), z("triangles"), z("years"), z("circular"), yes("ties"), yes("people"))
    financial = S.financial_points(*(F.col(c) for c in ("revenue", "spending", "program", "overhead", "gifts_in", "gifts_out", "pay", "circular")))
    temporal = V.total([V.banded(z("same_year"), TRIPS), V.banded(z("adjacent_year"), TRIPS), V.flag(yes("persistent"), 2), V.banded(z("multi_hop"), [(3, 2), (1, 1)])])
    told = j.select("node", circular.alias("circular_points"), financial.alias("financial_points"), temporal.alias("temporal_points"))
    return told.withColumn("score", F.least(F.col("circular_points") + F.col("financial_points") + F.col("temporal_points"), F.lit(MOST)))
