"""Review queue, evidence, reports by department and province, filing dossiers, linkage clusters: over the standard views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import aggregate as A
from ledgerlark.operators import entity as E
from ledgerlark.operators import scores as S
from ledgerlark.operators import topk as K
from ledgerlark.sources.store import dealt, written

from .registry import query
from .views import view

# Parameters of these queries.
KNOWN = ["Customer#000000001", "Customer#000000002"]  # recipients of the first tier
MODULES = [("amendments", ["amend", "value", "growth"], ["amendment", "creep"]), ("networks", ["loop", "circular", "shared"], ["network"]), ("recipients", ["ghost", "zombie", "you"], ["recipient", "the"])]


# Queue

_CASES = """cases AS MATERIALIZED (
    SELECT 'concentration' AS module, department || '/' || program AS case_id, vendor AS entity, CAST(least(100,
        round(100 * share)) AS BIGINT) AS score FROM (SELECT department, program, vendor,
        CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER (PARTITION BY department, program) AS DOUBLE) AS share,
        row_number() OVER (PARTITION BY department, program ORDER BY sum(amount) DESC, vendor) AS rn FROM {agreements} GROUP BY 1, 2,
        3) s WHERE rn = 1
    UNION ALL SELECT 'creep', 'c' || CAST(ref_number AS VARCHAR), arg_min(vendor, (amendment_date, line_id)), CAST(least(100, greatest(0,
        round(10 * CAST(max(agreement_value) AS DOUBLE) / CAST(min(agreement_value) AS DOUBLE)))) AS BIGINT) FROM {agreements} GROUP BY ref_number
    UNION ALL SELECT 'gap', CASE WHEN count(*) % 3 <> 0 THEN program || '/' || province END, min(vendor), CAST(count(DISTINCT department) AS BIGINT)
        FROM {agreements} GROUP BY program, province)"""


def _cases(spark, d):
    a = view(spark, d, "agreements").select("department", "program", "province", "vendor", "amount", "ref_number", "agreement_value", "amendment_date", "line_id")
    a = written(a, "agreements")
    shares = A.with_shares(a.groupBy("department", "program", "vendor").agg(F.sum("amount").alias("v")), "v", ["department", "program"])
    top = K.top_per_group(shares, ["department", "program"], [F.col("v").desc(), F.col("vendor")], 1, "rn")
    score = lambda c: F.least(F.lit(100), F.greatest(F.lit(0), F.round(c))).cast("long").alias("score")
    lead = top.select(F.lit("concentration").alias("module"), F.concat_ws("/", "department", "program").alias("case_id"), F.col("vendor").alias("entity"), score(F.col("share") * 100))
    growth = V.ratio(F.max("agreement_value"), F.min("agreement_value")) * 10
    creep = dealt(a, "ref_number").groupBy("ref_number").agg(F.min_by("vendor", F.struct("amendment_date", "line_id")).alias("entity"), score(growth)).select(F.lit("creep").alias("module"), F.concat(F.lit("c"), F.col("ref_number").cast("string")).alias("case_id"), "entity", "score")
    gaps = a.groupBy("program", "province").agg(F.count("*").alias("n"), F.min("vendor").alias("entity"), F.countDistinct("department").alias("score"))
    gap = gaps.select(F.lit("gap").alias("module"), F.when(F.col("n") % 3 != 0, F.concat_ws("/", "program", "province")).alias("case_id"), "entity", "score")
    return written(lead.unionByName(creep).unionByName(gap), "cases")


_BANDED = "CASE WHEN score >= 81 THEN 'critical' WHEN score >= 51 THEN 'elevated' ELSE 'low' END"


@query("module_readiness", "O-247", f"""
    WITH {_CASES} SELECT module, count(*) AS cases, round(avg(CASE WHEN case_id IS NOT NULL AND entity IS NOT NULL AND score IS NOT NULL THEN 1.0
        ELSE 0.0 END), 6) AS ready_share, avg(CASE WHEN case_id IS NOT NULL AND entity IS NOT NULL AND score IS NOT NULL THEN 1.0
        ELSE 0.0 END) >= 0.9 AS ready FROM cases GROUP BY module""")
def module_readiness(spark, d):
    return S.module_readiness(_cases(spark, d))


@query("action_queue", "O-246 O-262 O-261 O-265 O-263", f"""
    WITH {_CASES}, ready AS (SELECT module FROM cases GROUP BY 1
        HAVING avg(CASE WHEN case_id IS NOT NULL AND entity IS NOT NULL AND score IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9), r AS (SELECT *
        FROM cases WHERE module IN (SELECT module FROM ready)),
    g AS (SELECT entity, count(DISTINCT module) AS signals FROM r GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, case_id) AS turn FROM r)
    SELECT module, case_id, entity, score, turn, {_BANDED} AS band, CASE WHEN score >= 81 THEN 'review' WHEN score >= 51 THEN 'context'
        ELSE 'info' END AS tone, CASE WHEN score >= 81 THEN 'Immediate human reviewer escalation' WHEN score >= 51
        AND module = 'creep' THEN 'Verify amendment lineage and procurement rationale' WHEN score >= 51 THEN 'Request documents'
        ELSE 'Monitor / clarify source data' END AS action,
           CASE WHEN module = 'creep' THEN 'procurement integrity analyst' ELSE 'registry and grants reviewer' END AS reviewer, signals FROM t
               LEFT JOIN g USING (entity) WHERE turn <= 40""")
def action_queue(spark, d):
    return S.action_queue(_cases(spark, d), 40).select("module", "case_id", "entity", "score", "turn", "band", "tone", "action", "reviewer", "signals")


@query("related_signals", "O-248", f"""
    WITH {_CASES} SELECT a.module AS of_module, a.case_id AS of_case, b.module, b.case_id, b.score FROM cases a
        JOIN cases b ON a.entity = b.entity AND a.module <> b.module WHERE a.module = 'concentration' AND a.score >= 20""")
def related_signals(spark, d):
    cases = _cases(spark, d)
    return S.related_signals(cases, cases.where("module = 'concentration' and score >= 20"))


@query("copy_guard", "O-247", "SELECT source, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(fraud|illegal|guilty|criminal|corrupt|waste proven|wrongdoing proven|failure proven)\\b')) AS held FROM documents GROUP BY source")
def copy_guard(spark, d):
    return view(spark, d, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.count_if(S.copy_guard(F.col("text"))).alias("held"))


_TERMS = " UNION ALL ".join(f"SELECT '{m}' AS module, unnest({words}) AS word, {p} AS p" for m, terms, title in MODULES for words, p in ((terms, 3), (title, 1)))


@query("module_router", "O-249", f"""
    WITH t AS ({_TERMS}), w AS (SELECT conv_id, turn, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')),
        ' '))) AS word FROM conversations), s AS (SELECT conv_id, turn, module, CAST(sum(p) AS BIGINT) AS score FROM w JOIN t USING (word)
        GROUP BY 1, 2, 3) SELECT module, score, count(*) AS n FROM s GROUP BY 1, 2""")
def module_router(spark, d):
    texts = view(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    modules = spark.createDataFrame(MODULES, "module string, terms array<string>, title array<string>")
    return S.routed(texts, modules, "id", "text").groupBy("module", "score").agg(F.count("*").alias("n"))


# Evidence and tiers


@query("evidence", "O-221", """
    WITH s AS (SELECT CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT ref_number) AS refs, count(*) FILTER (WHERE NOT is_amendment) AS firsts
        FROM {agreements}), r AS (SELECT CAST(sum(total_value) AS DOUBLE) AS total FROM {recipients}), o AS (SELECT count(*) AS refs
        FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x)
    SELECT 'total granted' AS statistic, s.total AS value, r.total AS check_value, abs(s.total - r.total) <= 1e-6 * greatest(abs(s.total),
        1) AS agrees FROM s, r UNION ALL SELECT 'agreements', s.refs, o.refs, s.refs = o.refs FROM s, o
        UNION ALL SELECT 'first rows', s.firsts, o.refs, s.firsts = o.refs FROM s, o""")
def evidence(spark, d):
    a, lines = view(spark, d, "agreements"), view(spark, d, "lineitem").join(view(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    orders = lines.select("l_orderkey").distinct().agg(F.count("*"))
    return S.evidence([
        ("total granted", a.agg(F.sum("amount")), S.recipient_rollup(a).agg(F.sum("total_value"))),
        ("agreements", a.agg(F.countDistinct("ref_number")), orders),
        ("first rows", a.agg(F.count_if(~F.col("is_amendment"))), orders)])


@query("waste_tiers", "O-220", f"""
    WITH t AS (SELECT name AS entity, CAST(sum(total_value) AS DOUBLE) AS total, min(CASE WHEN name IN ('{"', '".join(KNOWN)}') THEN 1
        WHEN last_year < 2000 AND total_value >= 500000 THEN 2 WHEN recipient_type = 'F' AND bn IS NULL THEN 3 WHEN grant_count <= 2
        AND total_value >= 500000 THEN 4 END) AS tier FROM {{recipients}} GROUP BY 1)
    SELECT CAST(tier AS BIGINT) AS tier, ['known', 'ended', 'no number', 'dependent'][tier] AS label, count(*) AS entities, sum(total) AS total,
        round(sum(total) / (SELECT sum(total) FROM t), 6) AS share FROM t WHERE tier IS NOT NULL GROUP BY 1, 2""")
def waste_tiers(spark, d):
    r = written(S.recipient_rollup(view(spark, d, "agreements")).select(F.col("name").alias("entity"), "total_value", "last_year", "recipient_type", "bn", "grant_count"), "recipients")
    spent = r.groupBy("entity").agg(F.sum("total_value").cast("double").alias("total"))
    large = F.col("total_value") >= 500_000
    return S.tiered([
        (1, "known", r.where(F.col("entity").isin(KNOWN))), (2, "ended", r.where((F.col("last_year") < 2000) & large)),
        (3, "no number", r.where((F.col("recipient_type") == "F") & F.col("bn").isNull())), (4, "dependent", r.where((F.col("grant_count") <= 2) & large))], spent)


# Recipients


@query("individual_recipients", "O-217", """
    SELECT department, count(DISTINCT recipient) AS individuals, count(*) AS grants, CAST(sum(amount) AS DOUBLE) AS total,
        CAST(max(amount) AS DOUBLE) AS largest, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS average,
        count(*) - count(DISTINCT recipient) AS repeats FROM {agreements} WHERE recipient_type = 'P' AND NOT is_amendment GROUP BY department""")
def individual_recipients(spark, d):
    """Grants to people by department."""
    g = view(spark, d, "agreements").where("recipient_type = 'P' and not is_amendment").groupBy("department")
    g = g.agg(F.countDistinct("recipient").alias("individuals"), F.count("*").alias("grants"), F.sum("amount").alias("total"), F.max("amount").alias("largest"))
    return g.select("*", F.round(V.ratio(F.col("total"), F.col("grants")), 4).alias("average"), (F.col("grants") - F.col("individuals")).alias("repeats"))


@query("recipient_detail", "O-186", """
    WITH p AS (SELECT recipient, program, sum(amount) AS v, row_number() OVER (PARTITION BY recipient ORDER BY sum(amount) DESC,
        program) AS rn FROM {agreements} GROUP BY 1, 2), t AS (SELECT recipient, string_agg(program, '|' ORDER BY rn) AS programs FROM p
        WHERE rn <= 12 GROUP BY 1),
    y AS (SELECT recipient, string_agg(CAST(yr AS VARCHAR) || ':' || CAST(n AS VARCHAR), '|' ORDER BY yr) AS timeline
        FROM (SELECT recipient, year(start_date) AS yr, count(*) AS n FROM {agreements} GROUP BY 1, 2) x
        GROUP BY 1), q AS (SELECT recipient, string_agg(DISTINCT department, '|' ORDER BY department) AS departments FROM {agreements} GROUP BY 1)
    SELECT recipient, timeline, departments, programs FROM y JOIN q USING (recipient) JOIN t USING (recipient)""")
def recipient_detail(spark, d):
    """Per recipient: grants by year, departments, the twelve largest programs. One pass over the agreements."""
    cells = written(view(spark, d, "agreements").groupBy("recipient", "program", "department", F.year("start_date").alias("yr")).agg(F.sum("amount").alias("v"), F.count("*").alias("n")), "cells")
    listed = lambda g, order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("text")))), lambda x: x["text"]), "|")
    top = K.top_per_group(cells.groupBy("recipient", "program").agg(F.sum("v").alias("v")), ["recipient"], [F.col("v").desc(), F.col("program")], 12, "rn")
    programs = top.groupBy("recipient").agg(listed(top, ["rn"], F.col("program")).alias("programs"))
    years = cells.groupBy("recipient", "yr").agg(F.sum("n").alias("n"))
    timeline = years.groupBy("recipient").agg(listed(years, ["yr"], F.concat_ws(":", F.col("yr").cast("string"), F.col("n").cast("string"))).alias("timeline"))
    departments = cells.groupBy("recipient").agg(A.distinct_list(F.col("department")).alias("departments"))
    return timeline.join(departments, "recipient").join(programs, "recipient").select("recipient", "timeline", "departments", "programs")


@query("recipient_lists", "O-187", """
    SELECT list, count(*) AS recipients, CAST(sum(total_value) AS DOUBLE) AS total FROM (
        SELECT unnest(list_filter([CASE WHEN last_year < 2001 AND total_value >= 500000 THEN 'zombie' END, CASE WHEN grant_count BETWEEN 1 AND 2
            AND total_value >= 1000000 THEN 'dependency' END, CASE WHEN bn IS NULL AND recipient_type = 'F'
            AND total_value >= 100000 THEN 'ghost' END, CASE WHEN grant_count BETWEEN 1 AND 5 AND avg_value >= 100000 THEN 'pass_through' END, CASE
            WHEN recipient_type = 'F' AND last_year < 2000 AND total_value >= 1000000 THEN 'vanished' END], lambda x: x IS NOT NULL)) AS list,
            total_value FROM {recipients}) x GROUP BY list""")
def recipient_lists(spark, d):
    """The five batch lists in one pass: a recipient may stand on several."""
    large, company = F.col("total_value") >= 1_000_000, F.col("recipient_type") == "F"
    tests = {"zombie": (F.col("last_year") < 2001) & (F.col("total_value") >= 500_000), "dependency": F.col("grant_count").between(1, 2) & large, "ghost": F.col("bn").isNull() & company & (F.col("total_value") >= 100_000),
             "pass_through": F.col("grant_count").between(1, 5) & (F.col("avg_value") >= 100_000), "vanished": company & (F.col("last_year") < 2000) & large}
    named = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return S.recipient_rollup(view(spark, d, "agreements")).select(F.explode(named).alias("list"), "total_value").groupBy("list").agg(F.count("*").alias("recipients"), F.sum("total_value").alias("total"))


@query("entity_flags", "O-216", """
    SELECT recipient_key, array_to_string(list_filter([CASE WHEN bn IS NULL THEN 'no_number' END, CASE WHEN grant_count = 1
        AND total_value >= 1000000 THEN 'single_large_grant' END, CASE WHEN amendment_count > 2 * grant_count THEN 'many_amendments' END, CASE
        WHEN dept_count >= 3 THEN 'several_departments' END, CASE WHEN last_year < 2000 THEN 'inactive' END], lambda x: x IS NOT NULL), ',') AS flags
        FROM {recipients}""")
def entity_flags(spark, d):
    r = S.recipient_rollup(view(spark, d, "agreements"))
    flags = V.reasons((F.col("bn").isNull(), "no_number"), ((F.col("grant_count") == 1) & (F.col("total_value") >= 1_000_000), "single_large_grant"), (F.col("amendment_count") > 2 * F.col("grant_count"), "many_amendments"), (F.col("dept_count") >= 3, "several_departments"), (F.col("last_year") < 2000, "inactive"))
    return r.select("recipient_key", F.array_join(flags, ",").alias("flags"))


@query("program_concentration", "O-204", """
    WITH t AS (SELECT program, department, recipient, sum(amount) AS v FROM {agreements}
        GROUP BY 1, 2, 3), s AS (SELECT *, row_number() OVER (PARTITION BY program, department ORDER BY v DESC, recipient) AS rn FROM t)
    SELECT program, department, count(*) AS recipients, round(CAST(sum(v) FILTER (WHERE rn <= 3) AS DOUBLE) / CAST(sum(v) AS DOUBLE),
        6) AS top3_share, count(*) = 1 AS sole FROM s GROUP BY 1, 2""")
def program_concentration(spark, d):
    """Share of the three largest recipients of each program and whether it has only one."""
    t = written(view(spark, d, "agreements").groupBy("program", "department", "recipient").agg(F.sum("amount").alias("v")), "cells")
    top = K.top_per_group(t, ["program", "department"], [F.col("v").desc(), F.col("recipient")], 3, "rn").groupBy("program", "department").agg(F.sum("v").alias("top3"))
    g = t.groupBy("program", "department").agg(F.count("*").alias("recipients"), F.sum("v").alias("v")).join(top, ["program", "department"])
    return g.select("program", "department", "recipients", F.round(V.ratio(F.col("top3"), F.col("v")), 6).alias("top3_share"), (F.col("recipients") == 1).alias("sole"))


@query("duplicative_funding", "O-204 O-206", """
    SELECT recipient, program, count(DISTINCT department) AS departments, string_agg(DISTINCT department, '|' ORDER BY department) AS listed,
        CAST(sum(amount) AS DOUBLE) AS total FROM {agreements} WHERE NOT is_amendment GROUP BY 1, 2 HAVING count(DISTINCT department) >= 2""")
def duplicative_funding(spark, d):
    """Recipients that several departments fund under one program."""
    g = view(spark, d, "agreements").where("not is_amendment").groupBy("recipient", "program").agg(F.countDistinct("department").alias("departments"), A.distinct_list(F.col("department")).alias("listed"), F.sum("amount").alias("total"))
    return g.where("departments >= 2")


@query("policy_summary", "O-206 O-265", """
    WITH p AS (SELECT program, province, CAST(sum(amount) AS DOUBLE) AS v FROM {agreements}
        GROUP BY 1, 2), q AS (SELECT *, v / sum(v) OVER (PARTITION BY program) AS share, 1.0 / count(*) OVER (PARTITION BY program) AS even FROM p),
        z AS (SELECT program, CAST(least(100, greatest(0, round(100 * sum(abs(share - even)) / 2))) AS BIGINT) AS score FROM q GROUP BY 1)
    SELECT CASE WHEN score >= 81 THEN 'critical' WHEN score >= 51 THEN 'elevated' ELSE 'low' END AS band, count(*) AS programs,
        CAST(max(score) AS BIGINT) AS highest FROM z GROUP BY 1""")
def policy_summary(spark, d):
    """How far each program's spread over provinces is from an even one, as a score from 0 to 100, by band."""
    p = view(spark, d, "agreements").groupBy("program", "province").agg(F.sum("amount").cast("double").alias("v"))
    whole = p.groupBy("program").agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    gap = p.join(whole, "program").groupBy("program").agg((F.sum(F.abs(F.col("v") / F.col("t") - 1 / F.col("n"))) * 50).alias("gap")).select("program", S.clamped(F.col("gap")).alias("score"))
    band = S.level_of(F.col("score"), [(81, "critical"), (51, "elevated")], "low")
    return gap.groupBy(band.alias("band")).agg(F.count("*").alias("programs"), F.max("score").alias("highest"))


# Provinces, departments, years


@query("department_province", "O-212", """
    WITH c AS (SELECT department, province, CAST(sum(amount) AS DOUBLE) AS v FROM {agreements}
        GROUP BY 1, 2), n AS (SELECT n_name AS province, count(*) AS people FROM customer JOIN nation ON n_nationkey = c_nationkey
        GROUP BY 1), h AS (SELECT department, province, v / people AS per_head FROM c JOIN n USING (province))
    SELECT department, province, round(per_head, 4) AS per_head, round(per_head / avg(per_head) OVER (PARTITION BY department) - 1, 6) AS deviation FROM h""")
def department_province(spark, d):
    """Spending per head of each department in each province, and how far it is from the department's mean."""
    people = view(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people")).join(view(spark, d, "nation"), "n_nationkey").select(F.col("n_name").alias("province"), "people")
    h = view(spark, d, "agreements").groupBy("department", "province").agg(F.sum("amount").cast("double").alias("v")).join(people, "province").withColumn("per_head", F.col("v") / F.col("people"))
    mean = h.groupBy("department").agg(F.avg("per_head").alias("mean"))
    return h.join(mean, "department").select("department", "province", F.round("per_head", 4).alias("per_head"), F.round(F.col("per_head") / F.col("mean") - 1, 6).alias("deviation"))


_DIVE = {
    "vendor": "top vendors", "department": "by department", "province": "by province", "program": "by program", "year": "by year", "size": "by size", "number": "by number"}


@query("for_profit_lists", "O-213", """
    WITH a AS (SELECT *, CAST(year(start_date) AS VARCHAR) AS year, CASE WHEN amount >= 50000 THEN 'large' WHEN amount >= 10000 THEN 'middle'
        ELSE 'small' END AS size, CASE WHEN bn IS NULL THEN 'none' ELSE 'given' END AS number FROM {agreements}
        WHERE recipient_type = 'F' AND NOT is_amendment)
    """ + " UNION ALL ".join(f"SELECT '{label}' AS list, {col} AS item, count(*) AS grants, count(DISTINCT recipient) AS companies, CAST(sum(amount) AS DOUBLE) AS total FROM a GROUP BY {col}" for col, label in _DIVE.items()))
def for_profit_lists(spark, d):
    """Seven lists of grants to companies from one pass, as grouping sets."""
    a = view(spark, d, "agreements").where("recipient_type = 'F' and not is_amendment")
    size = F.when(F.col("amount") >= 50_000, "large").when(F.col("amount") >= 10_000, "middle").otherwise("small")
    items = F.array(*(F.struct(F.lit(label).alias("list"), F.col(c).alias("item")) for c, label in _DIVE.items()))
    rows = a.withColumn("year", F.year("start_date").cast("string")).withColumn("size", size).withColumn("number", F.when(F.col("bn").isNull(), "none").otherwise("given"))
    flat = rows.select(F.explode(items).alias("x"), "recipient", "amount").groupBy("x.list", "x.item", "recipient").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    return flat.groupBy("list", "item").agg(F.sum("n").alias("grants"), F.count("*").alias("companies"), F.sum("v").alias("total"))


_SECTIONS = {"ministry": "ministries", "vendor": "vendors", "services": "services", "year": "years", "fiscal": "fiscal years", "situation": "situations", "kind": "kinds", "size": "sizes", "month": "months", "line_no": "lines"}


@query("provincial_summary", "O-222", """
    WITH c AS (SELECT *, CAST(year(start_date) AS VARCHAR) AS year, CAST(year(start_date) + CASE WHEN month(start_date) >= 4 THEN 0
        ELSE -1 END AS VARCHAR) AS fiscal, CASE WHEN sole_source THEN 'direct' ELSE 'competitive' END AS kind, CASE WHEN amount >= 50000 THEN 'large'
        ELSE 'small' END AS size, CAST(month(start_date) AS VARCHAR) AS month, CAST(line AS VARCHAR) AS line_no FROM {contracts})
    """ + " UNION ALL ".join(f"SELECT '{label}' AS section, {col} AS item, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total FROM c GROUP BY {col}" for col, label in _SECTIONS.items()))
def provincial_summary(spark, d):
    """Ten sections over the contracts from one pass."""
    c = view(spark, d, "contracts")
    year, month = F.year("start_date"), F.month("start_date")
    c = c.withColumn("year", year.cast("string")).withColumn("fiscal", (year - F.when(month >= 4, 0).otherwise(1)).cast("string")).withColumn("kind", F.when(F.col("sole_source"), "direct").otherwise("competitive"))
    c = c.withColumn("size", F.when(F.col("amount") >= 50_000, "large").otherwise("small")).withColumn("month", month.cast("string")).withColumn("line_no", F.col("line").cast("string"))
    items = F.array(*(F.struct(F.lit(label).alias("section"), F.col(k).alias("item")) for k, label in _SECTIONS.items()))
    return c.select(F.explode(items).alias("x"), "amount").groupBy("x.section", "x.item").agg(F.count("*").alias("contracts"), F.sum("amount").alias("total"))


@query("ministry_dependency", "O-223", """
    WITH m AS (SELECT vendor, services, CAST(sum(amount) AS DOUBLE) AS v, count(*) AS n FROM {contracts}
        GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY vendor) AS share FROM m), y AS (SELECT vendor,
        count(DISTINCT services) AS kinds, count(DISTINCT year(start_date)) AS years, bool_or(sole_source) AND bool_or(NOT sole_source) AS dual
        FROM {contracts} GROUP BY 1)
    SELECT vendor, max(share) > 0.25 AS dependent, round(max(share), 6) AS top_share, any_value(kinds) AS kinds, any_value(years) AS years,
        any_value(dual) AS dual FROM s JOIN y USING (vendor) GROUP BY vendor""")
def ministry_dependency(spark, d):
    """Vendors that live off one kind of service, sell under both kinds of contract, and over how many years."""
    c = view(spark, d, "contracts")
    share = A.with_shares(c.groupBy("vendor", "services").agg(F.sum("amount").cast("double").alias("v")), "v", ["vendor"]).groupBy("vendor").agg(F.max("share").alias("top"))
    y = c.groupBy("vendor").agg(F.countDistinct("services").alias("kinds"), F.countDistinct(F.year("start_date")).alias("years"), (F.bool_or("sole_source") & F.bool_or(~F.col("sole_source"))).alias("dual"))
    return share.join(y, "vendor").select("vendor", (F.col("top") > 0.25).alias("dependent"), F.round("top", 6).alias("top_share"), "kinds", "years", "dual")


@query("ministry_drift", "O-223", """
    WITH y AS (SELECT vendor, year(start_date) AS yr, arg_max(services, (v, services)) AS lead
        FROM (SELECT vendor, start_date, services, sum(amount) OVER (PARTITION BY vendor, year(start_date),
        services) AS v FROM {contracts}) x GROUP BY 1, 2), l AS (SELECT *, lag(lead) OVER (PARTITION BY vendor ORDER BY yr) AS before FROM y)
    SELECT vendor, count(*) AS years, count(*) FILTER (WHERE before IS NOT NULL AND before <> lead) AS changes FROM l GROUP BY vendor""")
def ministry_drift(spark, d):
    """How often the largest buyer's service of a vendor changes from one year to the next."""
    per = view(spark, d, "contracts").groupBy("vendor", F.year("start_date").alias("yr"), "services").agg(F.sum("amount").alias("v"))
    lead = per.groupBy("vendor", "yr").agg(F.max_by("services", F.struct("v", "services")).alias("lead"))
    moved = lead.withColumn("before", F.lag("lead").over(Window.partitionBy("vendor").orderBy("yr")))  # one row per vendor and year
    return moved.groupBy("vendor").agg(F.count("*").alias("years"), F.count_if(F.col("before") != F.col("lead")).alias("changes"))


@query("contract_terms", "O-224", """
    SELECT vendor, ministry, count(*) AS contracts, round(avg(date_diff('day', award_date, start_date)), 4) AS days,
        round(sum(CAST(amount AS DOUBLE)) / nullif(sum(date_diff('day', award_date, start_date)), 0), 4) AS daily_rate,
        count(*) FILTER (WHERE amount BETWEEN 23750 AND 24999.99) AS below_limit, CAST(max(start_date) AS VARCHAR) AS last FROM {contracts}
        WHERE sole_source GROUP BY 1, 2""")
def contract_terms(spark, d):
    """Direct contracts of each vendor and place: duration, daily rate, amounts just below a limit."""
    c = view(spark, d, "contracts").where("sole_source").withColumn("days", F.datediff("start_date", "award_date"))
    g = c.groupBy("vendor", "ministry").agg(F.count("*").alias("contracts"), F.avg("days").alias("mean"), F.sum(F.col("amount").cast("double")).alias("v"), F.sum("days").alias("all"), F.count_if(F.col("amount").between(23_750, 24_999.99)).alias("below_limit"), F.max("start_date").alias("last"))
    return g.select("vendor", "ministry", "contracts", F.round("mean", 4).alias("days"), F.round(V.ratio(F.col("v"), F.col("all")), 4).alias("daily_rate"), "below_limit", "last")


@query("out_of_province", "O-224", """
    SELECT cn.n_name AS buyer, sn.n_name AS seller, cn.n_name <> sn.n_name AS outside, count(*) AS contracts,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2, 3""")
def out_of_province(spark, d):
    n = view(spark, d, "nation")
    g = view(spark, d, "gifts").groupBy("src", "dst").agg(F.count("*").alias("contracts"), F.sum("amount").alias("total"))
    named = g.join(n.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("buyer")), "src").join(n.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("seller")), "dst")
    return named.select("buyer", "seller", (F.col("buyer") != F.col("seller")).alias("outside"), "contracts", "total")


@query("grants_and_contracts", "O-225", """
    WITH g AS (SELECT department AS place, CAST(sum(amount) FILTER (WHERE NOT sole_source) AS DOUBLE) AS grants,
        CAST(sum(amount) FILTER (WHERE sole_source) AS DOUBLE) AS direct FROM {agreements}
        GROUP BY 1), y AS (SELECT department AS place, year(start_date) AS yr, CAST(sum(amount) AS DOUBLE) AS v FROM {agreements}
        GROUP BY 1, 2), v AS (SELECT place, stddev_samp(v) / avg(v) AS cv, count(*) AS years FROM y GROUP BY 1),
    l AS (SELECT department AS place, round(avg(CASE WHEN recipient_type = 'G' THEN 1.0 ELSE 0.0 END), 6) AS lottery_share, round(avg(date_diff('day',
        start_date, amendment_date)), 4) AS days_to_pay FROM {agreements} GROUP BY 1)
    SELECT place, grants, direct, round(grants / nullif(direct, 0), 6) AS ratio, round(cv, 6) AS volatility, years, lottery_share, days_to_pay FROM g
        JOIN v USING (place) JOIN l USING (place)""")
def grants_and_contracts(spark, d):
    """Ratio of the two kinds, volatility over years, share of one kind of recipient, days from award to payment; one pass, then years."""
    a = view(spark, d, "agreements")
    y = a.groupBy(F.col("department").alias("place"), F.year("start_date").alias("yr")).agg(A.sum_where(~F.col("sole_source"), F.col("amount")).alias("g"), A.sum_where(F.col("sole_source"), F.col("amount")).alias("s"), F.sum("amount").cast("double").alias("v"), F.count("*").alias("n"), F.count_if(F.col("recipient_type") == "G").alias("lot"), F.sum(F.datediff("amendment_date", "start_date")).alias("days"))
    g = y.groupBy("place").agg(F.sum("g").cast("double").alias("grants"), F.sum("s").cast("double").alias("direct"), (F.stddev_samp("v") / F.avg("v")).alias("cv"), F.count("*").alias("years"), F.sum("lot").alias("lot"), F.sum("n").alias("n"), F.sum("days").alias("days"))
    return g.select("place", "grants", "direct", F.round(V.ratio(F.col("grants"), F.col("direct")), 6).alias("ratio"), F.round("cv", 6).alias("volatility"), "years", F.round(V.ratio(F.col("lot"), F.col("n")), 6).alias("lottery_share"), F.round(V.ratio(F.col("days"), F.col("n")), 4).alias("days_to_pay"))


@query("registry_health", "O-226", """
    WITH r AS (SELECT *, date_diff('month', registered, DATE '2001-08-01') - CASE WHEN day(registered) > 1 THEN 1 ELSE 0 END AS months
        FROM {registry}), g AS (SELECT province, count(*) AS n, avg(CASE WHEN status = 'ACTIVE' THEN 1.0 ELSE 0.0 END) AS active, avg(CASE
        WHEN status <> 'DISSOLVED' THEN 1.0 ELSE 0.0 END) AS kept, avg(CASE WHEN months >= 120 THEN 1.0 ELSE 0.0 END) AS mature,
        count(*) FILTER (WHERE months >= 60 AND status = 'ACTIVE') * 1.0 / nullif(count(*) FILTER (WHERE months >= 60), 0) AS s5,
            count(*) FILTER (WHERE months >= 120 AND status = 'ACTIVE') * 1.0 / nullif(count(*) FILTER (WHERE months >= 120), 0) AS s10,
            count(*) FILTER (WHERE months >= 240 AND status = 'ACTIVE') * 1.0 / nullif(count(*) FILTER (WHERE months >= 240), 0) AS s20 FROM r
            GROUP BY 1)
    SELECT province, n, round(CAST(s5 AS DOUBLE), 6) AS survival_5, round(CAST(s10 AS DOUBLE), 6) AS survival_10, round(CAST(s20 AS DOUBLE),
        6) AS survival_20, round(0.4 * CAST(active AS DOUBLE) + 0.3 * CAST(kept AS DOUBLE) + 0.3 * CAST(mature AS DOUBLE), 6) AS health FROM g""")
def registry_health(spark, d):
    """Share of organisations still active after 5, 10 and 20 years, and a health score of 0.4, 0.3 and 0.3."""
    years = V.years_between(F.col("registered"), F.lit("2001-08-01").cast("date"))
    share = lambda t: F.avg(V.flag(t, 1))
    alive = F.col("status") == "ACTIVE"
    g = view(spark, d, "registry").withColumn("age", years).groupBy("province").agg(F.count("*").alias("n"), *(F.avg(F.when(F.col("age") >= k, V.flag(alive, 1))).alias(f"s{k}") for k in (5, 10, 20)), share(alive).alias("a"), share(F.col("status") != "DISSOLVED").alias("k"), share(F.col("age") >= 10).alias("m"))
    return g.select("province", "n", *(F.round(f"s{k}", 6).alias(f"survival_{k}") for k in (5, 10, 20)), F.round(0.4 * F.col("a") + 0.3 * F.col("k") + 0.3 * F.col("m"), 6).alias("health"))


@query("registration_seasons", "O-226", """
    SELECT CAST(month(registered) AS BIGINT) AS month, count(*) AS n, round(count(*) * 12.0 / (SELECT count(*)
        FROM {registry}), 6) AS times_even, round(avg(CASE WHEN year(registered) < 1980 THEN 1.0 ELSE 0.0 END), 6) AS early_share FROM {registry}
        GROUP BY 1""")
def registration_seasons(spark, d):
    """Registrations by month against an even spread, and the mix of eras in each."""
    g = view(spark, d, "registry").groupBy(F.month("registered").alias("month")).agg(F.count("*").alias("n"), F.avg(V.flag(F.year("registered") < 1980, 1)).alias("early"))
    whole = F.broadcast(g.agg(F.sum("n").alias("t")))  # one row
    return g.crossJoin(whole).select("month", "n", F.round(F.col("n") * 12 / F.col("t"), 6).alias("times_even"), F.round("early", 6).alias("early_share"))


# Filings


@query("government_funding", "O-210", """
    WITH f AS (SELECT year, c_mktsegment AS category, n_name AS designation, CAST(coalesce(a, 0) AS DOUBLE) AS gov, CAST(coalesce(total,
        0) AS DOUBLE) AS revenue FROM {filings} JOIN customer ON c_custkey = filer JOIN nation ON n_nationkey = c_nationkey)
    SELECT CAST(year AS BIGINT) AS year, category, designation, count(*) AS filings, round(sum(gov), 2) AS government, round(sum(revenue),
        2) AS revenue, round(sum(gov) / nullif(sum(revenue), 0), 6) AS share, count(*) FILTER (WHERE revenue > 0
        AND gov / revenue >= 0.5) AS high_share FROM f GROUP BY 1, 2, 3""")
def government_funding(spark, d):
    """Government money by year, category and designation, with the filings in which it is half of all or more."""
    c = view(spark, d, "customer").join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("filer"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("designation"))
    z = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    f = view(spark, d, "filings").select("filer", "year", z("a").alias("gov"), z("total").alias("revenue")).join(c, "filer")
    g = f.groupBy("year", "category", "designation").agg(F.count("*").alias("filings"), F.sum("gov").alias("g"), F.sum("revenue").alias("r"), F.count_if((F.col("revenue") > 0) & (F.col("gov") / F.nullif(F.col("revenue"), F.lit(0.0)) >= 0.5)).alias("high_share"))
    return g.select("year", "category", "designation", "filings", F.round("g", 2).alias("government"), F.round("r", 2).alias("revenue"), F.round(F.col("g") / F.nullif(F.col("r"), F.lit(0.0)), 6).alias("share"), "high_share")


@query("overhead_kinds", "O-211", """
    WITH f AS (SELECT *, coalesce(total, 0) > 450000 AS outlier, coalesce(a, 0) AS admin, coalesce(b, 0) AS fund, coalesce(c, 0) AS pay FROM {filings})
    SELECT CAST(year AS BIGINT) AS year, count(*) AS filings, count(*) FILTER (WHERE outlier) AS outliers,
        round(CAST(sum(admin) FILTER (WHERE NOT outlier) AS DOUBLE) / nullif(CAST(sum(admin + fund + pay) FILTER (WHERE NOT outlier) AS DOUBLE), 0),
        6) AS strict_overhead, round(CAST(sum(admin + fund) FILTER (WHERE NOT outlier) AS DOUBLE) / nullif(CAST(sum(admin + fund + pay) FILTER (WHERE NOT outlier) AS DOUBLE),
        0), 6) AS broad_overhead FROM f GROUP BY 1""")
def overhead_kinds(spark, d):
    """Strict overhead (one part) and broad overhead (two parts) by year, without the outliers, which are counted."""
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    inside = F.coalesce(F.col("total"), F.lit(0)) <= 450_000
    part = lambda *names: A.sum_where(inside, sum((z(n) for n in names[1:]), z(names[0])))
    g = view(spark, d, "filings").groupBy("year").agg(F.count("*").alias("filings"), F.count_if(~inside).alias("outliers"), part("a").alias("x"), part("a", "b").alias("y"), part("a", "b", "c").alias("t"))
    return g.select("year", "filings", "outliers", F.round(V.ratio(F.col("x"), F.col("t")), 6).alias("strict_overhead"), F.round(V.ratio(F.col("y"), F.col("t")), 6).alias("broad_overhead"))


@query("filing_dossier", "O-230", """
    WITH f AS (SELECT filer, year, count(*) AS filings, CAST(sum(coalesce(total, 0)) AS DOUBLE) AS revenue, CAST(sum(coalesce(a,
        0)) AS DOUBLE) AS field_a, CAST(sum(coalesce(b, 0)) AS DOUBLE) AS field_b, CAST(sum(coalesce(c, 0)) AS DOUBLE) AS field_c,
        string_agg(CAST(filing AS VARCHAR), ',' ORDER BY filing) AS numbers FROM {filings} GROUP BY 1, 2),
    p AS (SELECT person AS filer, year, string_agg(DISTINCT CAST(org AS VARCHAR), ',' ORDER BY CAST(org AS VARCHAR)) AS organisations FROM {roles}
        GROUP BY 1, 2), g AS (SELECT c_custkey AS filer, year(start_date) AS year, count(*) AS grants, CAST(sum(amount) AS DOUBLE) AS granted,
        string_agg(DISTINCT program, '|' ORDER BY program) AS programs, string_agg(DISTINCT department, '|' ORDER BY department) AS departments
        FROM {agreements} GROUP BY 1, 2)
    SELECT f.filer, CAST(f.year AS BIGINT) AS year, filings, revenue, field_a, field_b, field_c, numbers, organisations, grants, granted, programs,
        departments FROM f LEFT JOIN p ON p.filer = f.filer AND p.year = f.year LEFT JOIN g ON g.filer = f.filer AND g.year = f.year""")
def filing_dossier(spark, d):
    """Per filer and year all that is on file: filings, their fields and numbers, roles, grants with programs and departments. Each part is aggregated before it is joined."""
    z = lambda x: F.sum(F.coalesce(F.col(x), F.lit(0)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("filing")), lambda x: x.cast("string")), ",")
    f = view(spark, d, "filings").groupBy("filer", "year").agg(F.count("*").alias("filings"), z("total").alias("revenue"), *(z(k).alias(f"field_{k}") for k in "abc"), ids.alias("numbers"))
    p = view(spark, d, "roles").groupBy(F.col("person").alias("filer"), "year").agg(A.distinct_list(F.col("org").cast("string"), ",").alias("organisations"))
    g = view(spark, d, "agreements").groupBy(F.col("c_custkey").alias("filer"), F.year("start_date").alias("year")).agg(F.count("*").alias("grants"), F.sum("amount").alias("granted"), A.distinct_list(F.col("program")).alias("programs"), A.distinct_list(F.col("department")).alias("departments"))
    return f.join(p, ["filer", "year"], "left").join(g, ["filer", "year"], "left").select("filer", "year", "filings", "revenue", "field_a", "field_b", "field_c", "numbers", "organisations", "grants", "granted", "programs", "departments")


@query("gifts_both_ways", "O-231", """
    WITH o AS (SELECT src AS node, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS v, count(DISTINCT dst) AS p FROM {gifts}
        GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS v, count(DISTINCT src) AS p FROM {gifts} GROUP BY 1)
    SELECT CAST(coalesce(o.node, i.node) AS BIGINT) AS node, coalesce(o.n, 0) AS given, coalesce(o.v, 0) AS given_amount, coalesce(o.p,
        0) AS given_to, coalesce(i.n, 0) AS received, coalesce(i.v, 0) AS received_amount, coalesce(i.p, 0) AS received_from FROM o
        FULL JOIN i ON o.node = i.node""")
def gifts_both_ways(spark, d):
    """Gifts that each organisation gave and received: both sides of a gift in one aggregation."""
    sides = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("out")))
    per = view(spark, d, "gifts").select(F.explode(sides).alias("x"), "amount").groupBy("x.node", "x.other", "x.out").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    side = lambda k, name: (F.coalesce(A.sum_where(F.col("out") == k, F.col("n")), F.lit(0)).alias(name), F.coalesce(A.sum_where(F.col("out") == k, F.col("v")), F.lit(0)).alias(f"{name}_amount"), F.count_if(F.col("out") == k).alias("given_to" if k else "received_from"))
    return per.groupBy("node").agg(*side(1, "given"), *side(0, "received"))


@query("funding_view", "O-228", """
    WITH a AS (SELECT c_custkey AS id, CAST(sum(amount) FILTER (WHERE NOT is_amendment) AS DOUBLE) AS federal, count(*) AS federal_rows
        FROM {agreements} GROUP BY 1), f AS (SELECT filer AS id, CAST(sum(coalesce(a, 0)) AS DOUBLE) AS filed, count(*) AS filings FROM {filings}
        GROUP BY 1), o AS (SELECT o_custkey AS id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ordered FROM orders
        GROUP BY 1), r AS (SELECT person AS id, count(DISTINCT org) AS roles FROM {roles} GROUP BY 1), e AS (SELECT user_id AS id, count(*) AS events
        FROM events GROUP BY 1)
    SELECT c_custkey AS id, coalesce(federal, 0) AS federal, coalesce(federal_rows, 0) AS federal_rows, coalesce(filed, 0) AS filed, coalesce(filings,
        0) AS filings, coalesce(ordered, 0) AS ordered, coalesce(roles, 0) AS roles, coalesce(events, 0) AS events FROM customer
        LEFT JOIN a ON a.id = c_custkey LEFT JOIN f ON f.id = c_custkey LEFT JOIN o ON o.id = c_custkey LEFT JOIN r ON r.id = c_custkey
        LEFT JOIN e ON e.id = c_custkey""")
def funding_view(spark, d):
    """Five sources beside each entity, each aggregated to one row per entity before it is joined."""
    first = ~F.col("is_amendment")
    parts = [
        view(spark, d, "agreements").groupBy(F.col("c_custkey").alias("id")).agg(A.sum_where(first, F.col("amount")).alias("federal"), F.count("*").alias("federal_rows")),
        view(spark, d, "filings").groupBy(F.col("filer").alias("id")).agg(F.sum(F.coalesce("a", F.lit(0))).alias("filed"), F.count("*").alias("filings")),
        view(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("ordered")),
        view(spark, d, "roles").groupBy(F.col("person").alias("id")).agg(F.countDistinct("org").alias("roles")),
        view(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("events"))]
    rows = view(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    for p in parts:
        rows = rows.join(p, "id", "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c != "id"))


# Linkage and verdicts

_ANSWER = "CASE s_suppkey % 4 WHEN 0 THEN '```json' || chr(10) || '{\"verdict\": \"SAME\", \"confidence\": 0.9}' || chr(10) || '```' WHEN 1 THEN '{\"verdict\": \"RELATED\", \"confidence\": 0.4}' WHEN 2 THEN '{\"verdict\": \"different\"}' ELSE 'no json' END"
_VERDICTS = "v AS (SELECT s_suppkey AS id_a, s_suppkey + 1 AS id_b, CAST(s_nationkey AS DOUBLE) / 25 AS similarity, s_suppkey % 4 AS k FROM supplier)"


def _verdicts(spark, d):
    k = F.col("s_suppkey") % 4
    answer = F.when(k == 0, '```json\n{"verdict": "SAME", "confidence": 0.9}\n```').when(k == 1, '{"verdict": "RELATED", "confidence": 0.4}').when(k == 2, '{"verdict": "different"}').otherwise("no json")
    return E.parsed_verdicts(view(spark, d, "supplier").select(F.col("s_suppkey").alias("id_a"), (F.col("s_suppkey") + 1).alias("id_b"), (F.col("s_nationkey") / 25).alias("similarity"), answer.alias("response")))


@query("parsed_verdicts", "O-159", f"""
    WITH {_VERDICTS} SELECT id_a, id_b, ['SAME', 'RELATED', 'different', NULL][k + 1] AS verdict, CAST([0.9, 0.4, NULL,
        NULL][k + 1] AS DOUBLE) AS confidence, ['same', 'related', 'different', 'uncertain'][k + 1] AS status FROM v""")
def parsed_verdicts(spark, d):
    return _verdicts(spark, d).select("id_a", "id_b", "verdict", "confidence", "status")


@query("promoted_matches", "O-159", f"WITH {_VERDICTS} SELECT id_a, id_b, 'verdict' AS method, CAST(0.9 AS DOUBLE) AS confidence FROM v WHERE k = 0 AND similarity < 0.7")
def promoted_matches(spark, d):
    return E.promoted(_verdicts(spark, d))


@query("pipeline_status", "O-270", f"""
    WITH {_VERDICTS}, p AS (SELECT similarity AS probability, id_a % 10 AS cluster FROM v)
    SELECT 'predictions' AS measure, count(*) AS n FROM p UNION ALL SELECT 'high', count(*) FILTER (WHERE probability >= 0.95) FROM p
        UNION ALL SELECT 'middle', count(*) FILTER (WHERE probability >= 0.7 AND probability < 0.95) FROM p
        UNION ALL SELECT 'review', count(*) FILTER (WHERE probability >= 0.4 AND probability < 0.7) FROM p
        UNION ALL SELECT 'clusters', count(DISTINCT cluster) FROM p
    UNION ALL SELECT 'status:' || ['same', 'related', 'different', 'uncertain'][k + 1], count(*) FROM v GROUP BY k""")
def pipeline_status(spark, d):
    v = _verdicts(spark, d)
    return E.pipeline_status(v.select(F.col("similarity").alias("probability"), (F.col("id_a") % 10).alias("cluster")), v)


_PEOPLE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' Ltd' ELSE c_name END AS name, c_custkey // 3 AS k FROM customer"


@query("linkage_aliases", "O-155 O-156", f"""
    WITH p AS ({_PEOPLE}), e AS (SELECT a.id AS id_a, b.id AS id_b FROM p a
        JOIN p b ON a.k = b.k AND b.id = a.id + 1), c AS (SELECT id,
        min(id) OVER (PARTITION BY k) AS cluster FROM p WHERE id IN (SELECT id_a FROM e UNION SELECT id_b FROM e)), n AS (SELECT cluster, name,
        count(*) AS records FROM c JOIN p USING (id) GROUP BY 1, 2), l AS (SELECT cluster, arg_min(name, (-records, name)) AS canonical FROM n
        GROUP BY 1)
    SELECT cluster, canonical, name AS alias, records FROM n JOIN l USING (cluster) WHERE name <> canonical""")
def linkage_aliases(spark, d):
    """Predicted pairs at or above a threshold as clusters, and the other names in each."""
    key = F.col("c_custkey")
    p = view(spark, d, "customer").select(key.alias("id"), F.when(key % 3 == 0, F.concat("c_name", F.lit(" Ltd"))).otherwise(F.col("c_name")).alias("name"), F.floor(key / 3).alias("k"))
    predicted = p.select(F.col("id").alias("id_a"), "k", F.lit(0.9).alias("probability")).join(p.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"), F.col("k").alias("k_b")), "id_a").where("k = k_b and probability >= 0.4")
    return E.aliases_of(E.merge_clusters(predicted.select("id_a", "id_b")), p)
