"""Review scores of recipients, contracts, pairs and loops: transparent sums of banded points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.functions import values as V
from ledgerlark.sources.store import dealt

from . import aggregate as A
from . import latest as L

# Limits and points of the scores.
VALUE_BANDS = [(50_000_000, 5), (10_000_000, 4), (1_000_000, 3), (500_000, 2)]
AVERAGE_BANDS = [(50_000_000, 5), (10_000_000, 4), (1_000_000, 2)]
DEPARTMENT_BANDS = [(6, 3), (3, 2)]
CREEP_BANDS = [(10, 45), (5, 35), (3, 25)]
INCREASE_BANDS = [(1_000_000, 15), (100_000, 8)]
SHARED_BANDS = [(10, 5), (5, 4), (3, 3), (2, 2)]
FUNDING_BANDS = [(100_000_000, 5), (10_000_000, 4), (1_000_000, 3), (100_000, 2)]
BOTTLENECK_BANDS = [(1_000_000, 4), (100_000, 3), (10_000, 2)]
FLOW_BANDS = [(5_000_000, 4), (1_000_000, 3), (100_000, 2)]
RISK_LEVELS = [(15, "CRITICAL"), (10, "HIGH"), (6, "MEDIUM")]


def recipient_rollup(agreements: DataFrame) -> DataFrame:
    """One row per recipient: identity, counts, sums, departments and dates. Identity is the number, else name, type and province."""
    named = F.concat_ws("|", F.upper("recipient"), "recipient_type", F.upper("province"))
    key = F.when(F.col("bn").isNotNull(), F.concat(F.lit("BN:"), "bn")).otherwise(named)
    first = F.when(~F.col("is_amendment"), F.lit(1))
    g = agreements.withColumn("recipient_key", key).groupBy("recipient_key").agg(
        *(F.min(c).alias(a) for c, a in (("recipient", "name"), ("bn", "bn"), ("recipient_type", "recipient_type"), ("province", "province"))),
        F.count(first).alias("grant_count"), A.count_where(F.col("is_amendment")).alias("amendment_count"), F.sum("amount").alias("total_value"), F.max("amount").alias("max_value"), F.countDistinct("department").alias("dept_count"),
        F.min("start_date").alias("first_grant"), F.max("start_date").alias("last_grant"), F.max(F.when(F.col("is_amendment"), F.col("amendment_date"))).alias("last_amendment_date"))
    return g.withColumn("last_year", F.year("last_grant")).withColumn("avg_value", V.ratio(F.col("total_value"), F.col("grant_count")))


def zombie_score(recipients: DataFrame, as_of: str, quiet_before: int, gone_before: int, least: float = 500_000) -> DataFrame:
    """Recipients whose funding stopped: years since the last grant and bands of value, count, stale amendments and vanished companies."""
    large, years = F.col("total_value") >= 1_000_000, F.greatest(F.year(F.lit(as_of).cast("date")) - F.col("last_year"), F.lit(0))
    gone = (F.col("recipient_type") == "F") & (F.col("last_year") < gone_before) & large
    few = F.col("grant_count").between(1, 2) & large
    stale = F.col("last_amendment_date").isNull() | (F.year("last_amendment_date") < quiet_before)
    parts = [F.coalesce(years, F.lit(0)), V.banded(F.col("total_value"), VALUE_BANDS, 1), V.banded(F.col("grant_count"), [(1, 3), (2, 2), (5, 1)], 0, at_most=True), V.flag(stale, 2), V.flag(gone, 3)]
    kept = recipients.where((F.col("total_value") >= least) & F.coalesce((F.col("last_year") < quiet_before) | few | gone, F.lit(False)))
    return kept.withColumn("score", V.total(parts)).withColumn("signal", F.when(gone, "vanished").when(F.col("last_year") < quiet_before, "zombie").otherwise("dependency"))


def ghost_score(recipients: DataFrame, pass_average: float = 10_000_000) -> DataFrame:
    """Recipients that are hard to identify, or that take large sums in few grants, with the signal that comes first."""
    no_bn = F.col("bn").isNull() | (F.trim("bn") == "")
    company = F.coalesce(F.col("recipient_type") == "F", F.lit(False))
    passing = F.col("grant_count").between(1, 5) & (F.col("avg_value") >= pass_average)
    hidden, unnamed, many = no_bn & company & (F.col("total_value") >= 100_000), no_bn & (F.col("total_value") >= 500_000), company & (F.col("dept_count") >= 3)
    parts = [V.flag(no_bn, 4), V.flag(no_bn & company, 4), V.banded(F.col("total_value"), VALUE_BANDS, 1), V.banded(F.col("grant_count"), [(1, 3), (3, 2), (5, 1)], 0, at_most=True), V.banded(F.col("avg_value"), AVERAGE_BANDS), V.banded(F.col("dept_count"), DEPARTMENT_BANDS), V.flag(passing, 3)]
    signal = F.when(hidden, "for_profit_no_bn").when(unnamed, "no_bn").when(passing, "pass_through").otherwise("multi_department_for_profit")
    return recipients.where(hidden | unnamed | passing | many).withColumn("score", V.total(parts)).withColumn("signal", signal)


def amendment_creep(agreements: DataFrame, times: float = 3) -> DataFrame:
    """Agreements whose present value is far above the first, with score and reasons."""
    rows = L.with_agreement_key(agreements)
    # first row, present row and counts need the same grouping, so one aggregate gives them all
    place = lambda no, day: F.struct(F.coalesce("amend_no", F.lit(no)), F.coalesce("amendment_date", F.lit(day).cast("date")), "line_id")
    first = ~F.col("is_amendment") & (F.col("agreement_value") > 0)
    original = F.min_by(F.struct(F.col("recipient").alias("vendor"), "department", F.col("agreement_value").alias("original_value")), F.when(first, place(-1, "0001-01-01")))
    now = F.max_by(F.struct(F.col("agreement_value").alias("current_value"), F.col("is_amendment").alias("latest_is_amendment"), F.col("line_id").alias("current_id")), place(-1, "0001-01-01"))
    j = rows.groupBy(*L.AGREEMENT).agg(original.alias("original"), now.alias("now"), A.count_where(F.col("is_amendment")).alias("amendment_count"), F.count("*").alias("record_count"))
    j = j.where("original is not null").select(*L.AGREEMENT, "original.*", "now.*", "amendment_count", "record_count")
    j = j.where((F.col("current_value") > F.col("original_value") * times) & (F.col("latest_is_amendment") | (F.col("record_count") > 1)))
    ratio, more, near = V.ratio(F.col("current_value"), F.col("original_value")), F.col("current_value") - F.col("original_value"), V.near_threshold(F.col("original_value"))
    score = V.total([V.banded(ratio, CREEP_BANDS), V.banded(F.col("amendment_count"), [(3, 15), (1, 10)]), V.banded(more, INCREASE_BANDS), V.flag(near, 15)], cap=100)
    why = V.reasons((ratio >= 3, "value grew at least threefold"), (~F.col("latest_is_amendment"), "latest row is not an amendment"), (F.col("amendment_count") >= 3, "three or more amendments"), (more >= 1_000_000, "increase of a million or more"), (near, "first value just below a threshold"))
    return j.select("*", F.round(ratio, 2).alias("creep_ratio"), near.alias("near_threshold"), score.alias("score"), F.array_join(why, "; ").alias("why_flagged"))


def sole_source_followon(contracts: DataFrame, times: float = 3) -> DataFrame:
    """Vendors with competitive awards whose direct awards outgrow them. One aggregate over both kinds of contract."""
    sole = F.col("sole_source")
    g = contracts.where((F.col("amount") > 0) & F.col("vendor").isNotNull()).groupBy(N.vendor_key(F.col("vendor")).alias("vendor_key")).agg(
        F.min("vendor").alias("vendor"), F.sum(F.when(~sole, F.col("amount"))).alias("competitive_total"), F.max(F.when(~sole, F.col("amount"))).alias("largest_award"), A.count_where(~sole).alias("competitive_count"),
        F.sum(F.when(sole, F.col("amount"))).alias("sole_total"), A.count_where(sole).alias("sole_count"), A.count_where(sole & (F.lower(F.trim("situation")) == "z")).alias("nonstandard_count"))
    g = g.where((F.col("competitive_count") > 0) & (F.col("sole_count") > 0))
    more, near = F.col("sole_total") > F.col("competitive_total"), V.near_threshold(F.col("largest_award"))
    ratio = V.ratio(F.col("competitive_total") + F.col("sole_total"), F.col("competitive_total"))
    score = V.total([F.when(more, 35).otherwise(22), V.banded(F.col("sole_count"), [(5, 15), (2, 10)]), V.flag(F.col("nonstandard_count") > 0, 20), V.flag(F.col("competitive_count") >= 3, 10), V.flag(near, 15)], cap=100)
    return g.where((ratio > times) | more | (F.col("nonstandard_count") > 0)).select("*", F.concat(F.lit("ab:"), F.md5("vendor_key")).alias("case_id"), F.round(ratio, 2).alias("creep_ratio"), score.alias("score"))


def program_dominance(agreements: DataFrame, share: float = 0.8, least: float = 100_000) -> DataFrame:
    """(recipient, programs_dominated, dominated_value): who takes nearly all of a program of a department."""
    t = agreements.where(~F.col("is_amendment") & (F.col("amount") > 0)).groupBy("program", "department", "recipient").agg(F.sum("amount").alias("value"))
    s = A.with_shares(t, "value", ["program", "department"]).where((F.col("total") > least) & (F.col("share") > share))
    return s.groupBy("recipient").agg(F.count("*").alias("programs_dominated"), F.sum("value").alias("dominated_value"))


def risk_register(agreements: DataFrame, least: float, quiet: tuple[int, int, int], dominance_share: float = 0.8, undated_points: int = 2) -> DataFrame:
    """Recipients with points, at most five each, for cessation, identity, amendments, concentration, dependency and scale.

    ``quiet``: last years of funding that count as long ended, ended, and lately
    ended. A recipient without any date has ``undated_points`` and no others
    for cessation: an unknown year is no early year.
    """
    first = ~F.col("is_amendment")
    e = agreements.where(F.col("recipient").isNotNull() & ~F.coalesce(F.col("recipient_type").isin("P", "G", "I"), F.lit(False))).groupBy("recipient", "bn", "recipient_type").agg(
        F.max("province").alias("province"), A.count_where(first).alias("n"), A.count_where(~first).alias("amendments"), F.countDistinct("department").alias("departments"), F.coalesce(A.sum_where(first, F.col("amount")), F.lit(0)).alias("value"),
        F.coalesce(A.sum_where(~first & (F.col("amount") > 0), F.col("amount")), F.lit(0)).alias("more"), F.coalesce(A.sum_where(~first & (F.col("amount") < 0), F.col("amount")), F.lit(0)).alias("less"), F.max("amount").alias("largest"), F.max(F.year("start_date")).alias("last_year"))
    e = e.where(F.col("value") >= least).join(program_dominance(agreements, dominance_share), "recipient", "left")
    n, v, year, no_bn, company = F.col("n"), F.col("value").cast("double"), F.col("last_year"), F.col("bn").isNull() | (F.col("bn") == ""), F.coalesce(F.col("recipient_type") == "F", F.lit(False))
    rate, average = V.ratio(F.col("amendments"), F.greatest(n, F.lit(1))), V.ratio(F.col("value"), n)
    five = lambda *parts: V.total(parts, cap=5)
    some = F.col("amendments") > 0
    dims = {
        # Limits and points of the dimensions.
        "cessation": F.when(year.isNull(), undated_points).otherwise(five(F.when((year <= quiet[0]) & (v >= 1_000_000), 2).when((year <= quiet[1]) & (v >= 1_000_000), 1).otherwise(0), V.flag((n <= 3) & (v >= 500_000) & (year <= quiet[1]), 2), V.flag((n == 1) & (v >= 1_000_000) & (year <= quiet[2]), 1))),
        "identity": five(F.when(no_bn & company, 3).when(no_bn, 1).otherwise(0), V.flag(F.col("province").isNull(), 1), V.flag(no_bn & (n <= 2) & (v >= 500_000), 1)),
        "amendment": five(F.when(some, V.banded(rate, [(3, 2), (1, 1)])).otherwise(0), F.when(some & (F.col("more") > v * 2), 2).when(some & (F.col("more") > v), 1).otherwise(0), V.flag(some & (-F.col("less") > v * 0.5), 1)),
        "concentration": five(V.banded(F.coalesce("programs_dominated", F.lit(0)), [(3, 3), (1, 2)]), V.flag(F.col("dominated_value") >= 100_000_000, 2)),
        "dependency": five(F.when((n == 1) & (v >= 5_000_000), 3).when((n <= 2) & (v >= 1_000_000), 2).otherwise(0), F.when((F.col("departments") == 1) & (v >= 10_000_000), 2).when((F.col("departments") == 1) & (v >= 1_000_000), 1).otherwise(0)),
        "scale": five(V.banded(F.col("largest"), [(1_000_000_000, 3), (100_000_000, 2), (10_000_000, 1)]), F.when((n <= 2) & (average >= 50_000_000), 2).when((n <= 3) & (average >= 10_000_000), 1).otherwise(0)),
    }
    scored = e.select("recipient", "bn", "recipient_type", n.alias("grant_count"), F.col("value").alias("total_value"), *(c.cast("int").alias(k) for k, c in dims.items()))
    scored = scored.withColumn("score", V.total([F.col(k) for k in dims]))
    return scored.withColumn("level", level_of(F.col("score"), RISK_LEVELS, "LOW"))


def level_of(value: Column, levels: Sequence[tuple[float, str]], otherwise: str) -> Column:
    found = F.lit(otherwise)
    for limit, name in reversed(levels):
        found = F.when(value >= limit, name).otherwise(found)
    return found


def reconcile_yearly(granted: DataFrame, filed: DataFrame, least: float = 50_000) -> DataFrame:
    """Grants of a year against the largest revenue filed for it, the year before or the year after.

    ``granted``: (bn, year, amount), ``filed``: (bn, year, revenue). Filed rows are
    spread to the three years they may answer, so the window is an equi-join.
    """
    g = granted.groupBy("bn", "year").agg(F.sum("amount").alias("granted")).where(F.col("granted") >= least)
    per = filed.groupBy("bn", "year").agg(F.max("revenue").alias("revenue"))
    spread = per.select("bn", F.explode(F.array(*(F.col("year") + d for d in (-1, 0, 1)))).alias("year"), "revenue").groupBy("bn", "year").agg(F.max("revenue").alias("reported"))
    j = g.join(per.select("bn").distinct(), "bn", "left_semi").join(spread, ["bn", "year"], "left").withColumn("reported", F.greatest(F.coalesce("reported", F.lit(0)), F.lit(0)))
    r = F.col("granted").cast("double") / F.nullif(F.col("reported").cast("double"), F.lit(0.0))
    return j.withColumn("flag", F.when(F.col("reported") == 0, "REPORTS_ZERO").when(r <= 1.1, "RECONCILED").when(r <= 2, "SLIGHTLY_HIGHER").otherwise("MUCH_HIGHER"))


def reconcile_cumulative(granted: DataFrame, filed: DataFrame, least: float = 100_000) -> DataFrame:
    """All grants against all filed revenue and the growth of what is deferred. ``filed``: (bn, year, revenue, deferred). A year that does not state what is deferred is not the latest one."""
    g = granted.groupBy("bn").agg(F.sum("amount").alias("granted")).where(F.col("granted") >= least)
    per = filed.groupBy("bn", "year").agg(F.max("revenue").alias("revenue"), F.max("deferred").alias("deferred"))
    f = per.groupBy("bn").agg(F.sum(F.coalesce("revenue", F.lit(0))).alias("reported"), (F.max("deferred") - F.min("deferred")).alias("deferred_change"), F.max_by("deferred", F.when(F.col("deferred").isNotNull(), F.col("year"))).alias("latest_deferred"))
    j = g.join(f, "bn").withColumn("effective", F.col("reported") + F.greatest(F.coalesce("deferred_change", F.lit(0)), F.lit(0)))
    r = F.coalesce(F.col("granted").cast("double") / F.nullif(F.col("effective").cast("double"), F.lit(0.0)), F.lit(float("inf")))
    zero = (F.col("reported") == 0) & (F.coalesce("latest_deferred", F.lit(0)) == 0)
    return j.withColumn("flag", F.when(zero, "REPORTS_ZERO").when(r <= 1.15, "RECONCILED").when(r <= 2, "MODERATELY_HIGHER").when(r <= 5, "MUCH_HIGHER").otherwise("EXTREMELY_HIGHER"))


def governance_score(pairs: DataFrame, funding: DataFrame) -> DataFrame:
    """Pairs of organisations (org_a, org_b, shared_people, overlap_first_year, overlap_last_year[, related]) with their joint funding and score."""
    f = lambda s: funding.select(F.col("org").alias(f"org_{s}"), F.col("funding").alias(f"funding_{s}"))
    j = pairs.join(f("a"), "org_a", "left").join(f("b"), "org_b", "left").withColumn("joint_funding", F.coalesce("funding_a", F.lit(0)) + F.coalesce("funding_b", F.lit(0)))
    overlap = F.col("overlap_last_year") >= F.col("overlap_first_year")
    parts = [V.banded(F.col("shared_people"), SHARED_BANDS, 1), V.banded(F.col("joint_funding"), FUNDING_BANDS, 1), V.flag(overlap, 2)]
    parts += [V.flag(F.col("related"), 2)] if "related" in pairs.columns else []
    years = F.when(overlap, F.col("overlap_last_year") - F.col("overlap_first_year") + 1).otherwise(0)
    return j.withColumn("overlap_years", years).withColumn("score", V.total(parts))


def loop_watch_score(hops: Column, members: Column, bottleneck: Column, flow: Column, same_year: Column, member_score: Column) -> Column:
    """Order of loops for review."""
    small = lambda c, bands: F.when(c > 0, V.banded(c, bands, 1)).otherwise(0)
    return V.total([member_score, V.flag(same_year, 4), small(bottleneck, BOTTLENECK_BANDS), small(flow, FLOW_BANDS), F.least(hops, F.lit(6)), F.least(members, F.lit(6))])


def concentration_priority(hhi: Column, top_share: Column, entities: Column) -> Column:
    return F.least(F.lit(100), F.round(hhi * 70 + top_share * 25 + F.when(entities <= 9, 5).otherwise(0))).cast("int")


def growth_priority(change: Column, hhi: Column, amendment_share: Column) -> Column:
    return F.round(F.least(F.lit(50.0), F.abs(change) / 10_000_000) + F.least(F.lit(35.0), hhi * 35) + F.least(F.lit(15.0), amendment_share * 15)).cast("int")


def clamped(value: Column) -> Column:
    return F.least(F.greatest(F.round(value), F.lit(0)), F.lit(100)).cast("int")


def temporal_loop_score(yearly: DataFrame, symmetry: float = 0.5) -> DataFrame:
    """(node, same_year, adjacent_year, temporal_score): gifts that come back in the same or in the next year. ``yearly``: (src, dst, year, amount).

    A gift that is answered in its own year is not counted again for the next.
    """
    back = lambda apart, name: yearly.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("year") - apart).alias("year"), F.col("amount").alias(name))
    near = lambda c: F.coalesce(V.ratio(F.least("amount", c), F.greatest("amount", c)) > symmetry, F.lit(False)) & F.col(c).isNotNull()
    j = yearly.join(back(0, "now"), ["src", "dst", "year"], "left").join(back(1, "later"), ["src", "dst", "year"], "left")
    j = j.select("src", "dst", near("now").alias("same"), near("later").alias("next"))
    per = j.groupBy("src", "dst").agg(A.count_where(F.col("same")).alias("sy"), A.count_where(F.col("next") & ~F.col("same")).alias("ay"))
    n = per.groupBy(F.col("src").alias("node")).agg(F.sum("sy").alias("same_year"), F.sum("ay").alias("adjacent_year"), F.max(F.col("sy") + F.col("ay")).alias("years"))
    trips = [(5, 4), (3, 3), (1, 2)]
    return n.where(F.col("years") > 0).select("node", "same_year", "adjacent_year", V.total([V.banded(F.col("same_year"), trips), V.banded(F.col("adjacent_year"), trips), V.flag(F.col("years") >= 2, 2)]).alias("temporal_score"))


def circular_flows(members: DataFrame, yearly: DataFrame) -> DataFrame:
    """(node, partners, triangles, sent, received, circular, years): what a node gives to and gets from its partners on cycles.

    ``members``: (node, hops, sends_to, receives_from), ``yearly``: (src, dst, year, amount). One join each way, over
    distinct partners, so a gift on many cycles counts once.
    """
    kinds = members.groupBy("node").agg(F.countDistinct(F.when(F.col("hops") == 2, F.col("sends_to"))).alias("partners"), A.count_where(F.col("hops") == 3).alias("triangles"))
    side = lambda mine, other, partner, name: yearly.join(members.select("node", F.col(partner).alias("p")).distinct(), (F.col(mine) == F.col("node")) & (F.col(other) == F.col("p"))).select("node", "year", F.col("amount").alias("value"), F.lit(name).alias("way"))
    moved = side("src", "dst", "sends_to", "sent").unionByName(side("dst", "src", "receives_from", "received"))
    sums = moved.groupBy("node").agg(*(F.coalesce(A.sum_where(F.col("way") == w, F.col("value")), F.lit(0)).alias(w) for w in ("sent", "received")), F.countDistinct("year").alias("years"))
    return kinds.join(sums, "node").withColumn("circular", F.least("sent", "received"))


def circular_points(partners: Column, triangles: Column, years: Column, circular: Column, associated: Column | None = None, shared: Column | None = None) -> Column:
    """0 to 6: give-and-take partners, several cycles, several years, large sums, associated bodies, shared people."""
    tests = [partners > 0, (partners >= 2) | (triangles > 0), years >= 2, circular > 100_000, *(t for t in (associated, shared) if t is not None)]
    return V.total([V.flag(t, 1) for t in tests])


def financial_points(revenue: Column, spending: Column, program: Column, overhead: Column, gifts_in: Column, gifts_out: Column, pay: Column, circular: Column) -> Column:
    """0 to 12: overhead, dependence on gifts, pass-through, little program work, pay above it, circular sums above it."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    r, s, p, o, gi, go, w, c = map(z, (revenue, spending, program, overhead, gifts_in, gifts_out, pay, circular))
    share = F.when(s > 0, F.round(o / s * 100, 1)).otherwise(0.0)
    passing = (gi > 50_000) & (go > 0) & (F.least(gi, go) > F.greatest(gi, go) * 0.5)
    return V.total([F.when(share > 40, 2).when(share > 25, 1).otherwise(0), V.flag((r > 0) & (gi > r * 0.5), 2), V.flag(passing, 2), V.flag((r > 100_000) & (p < r * 0.2), 2), V.flag((w > 0) & (p > 0) & (w > p), 2), V.flag((p > 0) & (c > p * 2), 2)])


def loop_financials(found: DataFrame, yearly: DataFrame) -> DataFrame:
    """Per cycle what its edges carried within its own years: (path_key, window_bottleneck, window_flow, active_years).

    ``found``: cycles with path, min_year and max_year; ``yearly``: (src, dst, year, amount).
    """
    n = F.size("path")
    hops = found.select("path_key", "min_year", "max_year", "path", F.posexplode("path").alias("at", "src")).select("path_key", "min_year", "max_year", "src", F.element_at("path", (F.col("at") + 1) % n + 1).alias("dst"))
    flows = hops.join(yearly, ["src", "dst"]).where(F.col("year").between(F.col("min_year"), F.col("max_year")))
    edges = flows.groupBy("path_key", "src", "dst").agg(F.sum("amount").alias("w"), F.countDistinct("year").alias("years"))
    return edges.groupBy("path_key").agg(F.min("w").alias("window_bottleneck"), F.sum("w").alias("window_flow"), F.max("years").alias("active_years"))


def loop_report(found: DataFrame) -> DataFrame:
    """Per number of hops: loops, members, largest bottleneck, flow, and loops of one year."""
    by = found.groupBy("hops").agg(F.count("*").alias("loops"), F.max("bottleneck").alias("largest_bottleneck"), F.sum("total_flow").alias("flow"), A.count_where(F.col("min_year") == F.col("max_year")).alias("same_year"))
    members = found.select("hops", F.explode("path").alias("node")).groupBy("hops").agg(F.countDistinct("node").alias("members"))
    return by.join(members, "hops")


def sector_baseline(given: DataFrame, members: DataFrame) -> DataFrame:
    """Mean of ``given`` (node, given, sector) over all and over loop members of each sector, and how many times the one is the other."""
    j = given.join(members.select("node", F.lit(True).alias("looped")), "node", "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
    g = j.groupBy("sector").agg(F.count("*").alias("members"), A.count_where(F.col("looped")).alias("loop_members"), F.avg("given").alias("mean"), F.avg(F.when(F.col("looped"), F.col("given"))).alias("loop_mean"))
    return g.select("sector", "members", "loop_members", F.round("mean", 4).alias("sector_mean"), F.round("loop_mean", 4).alias("loop_mean"), F.round(V.ratio(F.col("loop_mean"), F.col("mean")), 6).alias("times_sector"))


# Bands, actions and reviewers of the queue by module.
QUEUE_BANDS = {"zombie": (9, 13), "ghost": (10, 15), "loop": (12, 18), "creep": (51, 81), "concentration": (51, 81), "policy": (51, 81), "overlap": (51, 81), "gap": (51, 81)}
REVIEWERS = {"zombie": "registry and grants reviewer", "ghost": "program integrity analyst", "loop": "CRA/network analyst", "creep": "procurement integrity analyst"}
ESCALATE, LINEAGE, NETWORK, DOCUMENTS, MONITOR = "Immediate human reviewer escalation", "Verify amendment lineage and procurement rationale", "Request network review", "Request documents", "Monitor / clarify source data"


def queue_rows(cases: DataFrame) -> DataFrame:
    """``cases`` (module, case_id, entity, score) with band, tone, action and reviewer by the module's limits."""
    limits = F.create_map(*(x for k, (lo, hi) in QUEUE_BANDS.items() for x in (F.lit(k), F.array(F.lit(lo), F.lit(hi)))))
    at = lambda i: F.element_at(F.element_at(limits, F.col("module")), i)
    band = F.when(F.col("score") >= at(2), "critical").when(F.col("score") >= at(1), "elevated").otherwise("low")
    action = F.when(F.col("band") == "critical", ESCALATE).when((F.col("band") == "elevated") & (F.col("module") == "creep"), LINEAGE).when((F.col("band") == "elevated") & (F.col("module") == "loop"), NETWORK).when(F.col("band") == "elevated", DOCUMENTS).otherwise(MONITOR)
    who = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REVIEWERS.items() for x in kv)), F.col("module")), F.lit(REVIEWERS["zombie"]))
    tone = F.when(F.col("band") == "critical", "review").when(F.col("band") == "elevated", "context").otherwise("info")
    return cases.withColumn("band", band).withColumn("tone", tone).withColumn("action", action).withColumn("reviewer", who)


def module_readiness(cases: DataFrame, least: float = 0.9) -> DataFrame:
    """(module, cases, ready_share, ready): share of a module's cases with an id, an entity and a score, against what it needs to be shown."""
    whole = V.flag(F.col("case_id").isNotNull() & F.col("entity").isNotNull() & F.col("score").isNotNull(), 1)
    g = cases.groupBy("module").agg(F.count("*").alias("cases"), F.avg(whole).alias("share"))
    return g.select("module", "cases", F.round("share", 6).alias("ready_share"), (F.col("share") >= least).alias("ready"))


def action_queue(cases: DataFrame, each: int, least: float = 0.9) -> DataFrame:
    """The ``each`` first cases of every module that is ready, with how many modules name the entity, and their turn.

    Modules come in turn: all first cases, then all second ones. Per-module
    order is a row number with a limit, and cases are dealt before it, so a
    large module is not sorted whole. ``cases`` are counted: store them first.
    """
    ready = module_readiness(cases, least).where("ready").select("module")
    rows = cases.join(ready, "module", "left_semi")
    signals = rows.where("entity is not null").groupBy("entity").agg(F.countDistinct("module").alias("signals"))
    from ledgerlark.operators.topk import top_per_group

    pieces = dealt(queue_rows(rows), "module", "case_id", "entity", "score", count=cases.count())
    first = top_per_group(pieces, ["module"], [F.col("score").desc(), F.col("case_id")], each, "turn")
    return first.join(signals, "entity", "left")


# What a text for reviewers must not claim.
COPY_GUARD = r"\b(fraud|illegal|guilty|criminal|corrupt|waste proven|wrongdoing proven|failure proven)\b"


def copy_guard(text: Column) -> Column:
    """Whether a text that is shown to reviewers claims more than a signal can."""
    return F.coalesce(F.lower(text).rlike(COPY_GUARD), F.lit(False))


def related_signals(cases: DataFrame, asked: DataFrame) -> DataFrame:
    """Cases of other modules for the entities of the asked ones (module, case_id, entity)."""
    a = asked.select(F.col("module").alias("of_module"), F.col("case_id").alias("of_case"), "entity").where("entity is not null")
    return a.join(cases, "entity").where("module <> of_module").select("of_module", "of_case", "module", "case_id", "score")


def tiered(tiers: Sequence[tuple[int, str, DataFrame]], spent: DataFrame) -> DataFrame:
    """(tier, label, entities, total, share): each entity counts in its first tier. A tier is (number, label, entities); ``spent``: (entity, total)."""
    named = None
    for tier, label, rows in tiers:
        one = rows.select("entity", F.lit(tier).alias("tier"), F.lit(label).alias("label")).distinct()
        named = one if named is None else named.unionByName(one)
    first = named.groupBy("entity").agg(F.min(F.struct("tier", "label")).alias("t"))
    whole = F.broadcast(spent.agg(F.sum("total").alias("whole")))  # one row
    g = spent.join(first, "entity").groupBy("t").agg(F.count("*").alias("entities"), F.sum("total").alias("total"))
    return g.crossJoin(whole).select("t.tier", "t.label", "entities", "total", F.round(V.ratio(F.col("total"), F.col("whole")), 6).alias("share"))


def evidence(statistics: Sequence[tuple[str, DataFrame, DataFrame]], tolerance: float = 1e-6) -> DataFrame:
    """(statistic, value, check_value, agrees): each number with the same number by another way; a frame has one row and one column."""
    found = None
    for name, value, check in statistics:
        one = value.toDF("value").select(F.lit(name).alias("statistic"), F.col("value").cast("double")).crossJoin(F.broadcast(check.toDF("check_value").select(F.col("check_value").cast("double"))))
        found = one if found is None else found.unionByName(one)
    gap = F.abs(F.col("value") - F.col("check_value")) <= tolerance * F.greatest(F.abs("value"), F.lit(1.0))
    return found.withColumn("agrees", F.coalesce(gap, F.lit(False)))


def routed(texts: DataFrame, modules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, module, score): three points for each term of a module that a text holds, one for each word of its title. ``modules``: (module, terms, title), a handful of rows."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text_col), "[^a-z0-9]+", " ")), " "))
    asked = texts.select(F.col(id_col).alias("id"), words.alias("words")).select("id", F.explode("words").alias("word"))
    points = modules.select("module", F.explode("terms").alias("word"), F.lit(3).alias("p")).unionByName(modules.select("module", F.explode("title").alias("word"), F.lit(1).alias("p")))
    return asked.join(points, "word").groupBy("id", "module").agg(F.sum("p").alias("score"))


def zombie_summary(rollup: DataFrame, as_of_year: int, quiet: int, gone: int) -> DataFrame:
    """(recipient_key, total_value, years_since, signal, signals, score): the older score, with years in bands.

    ``rollup``: as of ``recipient_rollup``. A for-profit recipient last seen
    before ``gone`` comes before one that is quiet since ``quiet``, and that
    before one that lives on one or two grants; the first names the row.
    """
    value, count, last = F.coalesce(F.col("total_value").cast("double"), F.lit(0.0)), F.coalesce("grant_count", F.lit(0)), F.coalesce("last_year", F.lit(0))
    zombie = (last > 0) & (last < quiet) & (value >= 500_000)
    dependent = (count > 0) & (count <= 2) & (value >= 1_000_000)
    vanished = F.coalesce(F.col("recipient_type") == "F", F.lit(False)) & (last > 0) & (last < gone) & (value >= 1_000_000)
    no_amendments = F.col("last_amendment_date").isNull() | (F.year("last_amendment_date") < quiet)
    signals = F.array_compact(F.array(F.when(vanished, "disappeared_for_profit"), F.when(zombie, "zombie"), F.when(dependent, "high_dependency")))
    since = F.greatest(F.lit(as_of_year) - last, F.lit(0))
    r = rollup.select("recipient_key", "total_value", since.alias("years_since"), signals.alias("signals"), value.alias("v"), count.alias("n"), no_amendments.alias("quiet"), vanished.alias("gone"))
    years = F.when(F.col("years_since") >= 8, 7).when(F.col("years_since") >= 5, 5).when(F.col("years_since") >= 3, 3).otherwise(1)
    money = F.when(F.col("v") >= 50_000_000, 5).when(F.col("v") >= 10_000_000, 4).when(F.col("v") >= 1_000_000, 3).when(F.col("v") >= 500_000, 2).otherwise(1)
    grants = F.when(F.col("n") <= 1, 3).when(F.col("n") <= 2, 2).when(F.col("n") <= 5, 1).otherwise(0)
    score = V.total([years, money, grants, V.flag(F.col("quiet"), 2), V.flag(F.col("gone"), 3)])
    return r.where(F.size("signals") > 0).select("recipient_key", "total_value", "years_since", F.element_at("signals", 1).alias("signal"), F.array_join("signals", ",").alias("signals"), score.alias("score"))


def signal_counts(summary: DataFrame, high: int = 13) -> DataFrame:
    """(signal, recipients, total_value, high): the counts beside the list."""
    return summary.groupBy("signal").agg(F.count("*").alias("recipients"), F.sum("total_value").alias("total_value"), A.count_where(F.col("score") >= high).alias("high"))
