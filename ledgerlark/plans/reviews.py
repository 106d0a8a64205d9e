"""Scores, reconciliation and concentration over the standard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import aggregate as A
from ledgerlark.operators import graph as G
from ledgerlark.operators import scores as S
from ledgerlark.operators import topk as K

from .registry import query
from .relational import CURRENT, ORIGINAL
from .views import view

# Parameters of these queries: the standard orders end in August 2001.
AS_OF, QUIET, GONE = "2001-08-01", 2001, 2000

_VALUE = "CASE WHEN total_value >= 50000000 THEN 5 WHEN total_value >= 10000000 THEN 4 WHEN total_value >= 1000000 THEN 3 WHEN total_value >= 500000 THEN 2 ELSE 1 END"


@query("recipient_rollup", "O-182 O-030", """
    SELECT recipient_key, name, bn, recipient_type, province, grant_count, CAST(amendment_count AS BIGINT) AS amendment_count,
        CAST(total_value AS DOUBLE) AS total_value, CAST(max_value AS DOUBLE) AS max_value, dept_count,
           CAST(first_grant AS VARCHAR) AS first_grant, CAST(last_grant AS VARCHAR) AS last_grant,
               CAST(last_amendment_date AS VARCHAR) AS last_amendment_date, CAST(last_year AS BIGINT) AS last_year, round(avg_value, 8) AS avg_value
               FROM {recipients}""")
def recipient_rollup(spark, d):
    return S.recipient_rollup(view(spark, d, "agreements")).withColumn("avg_value", F.round("avg_value", 8))


@query("zombie_score", "O-183", f"""
    WITH r AS (SELECT *, recipient_type = 'F' AND last_year < {GONE} AND total_value >= 1000000 AS gone FROM {{recipients}} WHERE total_value >= 500000)
    SELECT recipient_key, CAST(total_value AS DOUBLE) AS total_value, CAST(greatest(2001 - last_year, 0) + {_VALUE} + CASE
        WHEN grant_count <= 1 THEN 3 WHEN grant_count <= 2 THEN 2 WHEN grant_count <= 5 THEN 1 ELSE 0 END + CASE WHEN last_amendment_date IS NULL
        OR year(last_amendment_date) < {QUIET} THEN 2 ELSE 0 END + CASE WHEN gone THEN 3 ELSE 0 END AS BIGINT) AS score,
           CASE WHEN gone THEN 'vanished' WHEN last_year < {QUIET} THEN 'zombie' ELSE 'dependency' END AS signal FROM r
               WHERE last_year < {QUIET} OR (grant_count BETWEEN 1 AND 2 AND total_value >= 1000000) OR gone""")
def zombie_score(spark, d):
    z = S.zombie_score(S.recipient_rollup(view(spark, d, "agreements")), AS_OF, QUIET, GONE)
    return z.select("recipient_key", "total_value", "score", "signal")


@query("ghost_score", "O-185", f"""
    WITH r AS (SELECT *, bn IS NULL OR trim(bn) = '' AS nobn, recipient_type = 'F' AS co, grant_count BETWEEN 1 AND 5 AND avg_value >= 100000 AS pass FROM {{recipients}})
    SELECT recipient_key, CAST(CASE WHEN nobn THEN 4 ELSE 0 END + CASE WHEN nobn AND co THEN 4 ELSE 0 END + {_VALUE} + CASE
        WHEN grant_count <= 1 THEN 3 WHEN grant_count <= 3 THEN 2 WHEN grant_count <= 5 THEN 1 ELSE 0 END + CASE WHEN avg_value >= 50000000 THEN 5
        WHEN avg_value >= 10000000 THEN 4 WHEN avg_value >= 1000000 THEN 2 ELSE 0 END
                + CASE WHEN dept_count >= 6 THEN 3 WHEN dept_count >= 3 THEN 2 ELSE 0 END + CASE WHEN pass THEN 3 ELSE 0 END AS BIGINT) AS score,
           CASE WHEN nobn AND co AND total_value >= 100000 THEN 'for_profit_no_bn' WHEN nobn AND total_value >= 500000 THEN 'no_bn'
               WHEN pass THEN 'pass_through' ELSE 'multi_department_for_profit' END AS signal
    FROM r WHERE (nobn AND co AND total_value >= 100000) OR (nobn AND total_value >= 500000) OR pass OR (co AND dept_count >= 3)""")
def ghost_score(spark, d):
    return S.ghost_score(S.recipient_rollup(view(spark, d, "agreements")), 100_000).select("recipient_key", "score", "signal")


_NEAR = "len(list_filter([25000, 75000, 100000], lambda t: {x} >= t * 0.95 AND {x} < t)) > 0"


@query("amendment_creep", "O-192 O-194 O-195 O-038", f"""
    WITH o AS (SELECT *, coalesce(bn, recipient, line_id) AS party FROM {{agreements}}
        WHERE NOT is_amendment AND agreement_value > 0 QUALIFY {ORIGINAL} = 1), c AS (SELECT *, coalesce(bn, recipient, line_id) AS party
        FROM {{agreements}} QUALIFY {CURRENT} = 1),
    n AS (SELECT ref_number, coalesce(bn, recipient, line_id) AS party, count(*) FILTER (WHERE is_amendment) AS amendments, count(*) AS records FROM {{agreements}} GROUP BY 1, 2),
    j AS (SELECT o.ref_number, o.recipient AS vendor, o.agreement_value AS v0, c.agreement_value AS v1, c.is_amendment AS ia, amendments, records,
        {_NEAR.format(x='o.agreement_value')} AS near FROM o JOIN c ON o.ref_number = c.ref_number AND o.party = c.party
        JOIN n ON o.ref_number = n.ref_number AND o.party = n.party
        WHERE c.agreement_value > o.agreement_value * 3 AND (c.is_amendment OR records > 1))
    SELECT ref_number, vendor, CAST(v0 AS DOUBLE) AS original_value, CAST(v1 AS DOUBLE) AS current_value, amendments AS amendment_count, near AS near_threshold,
           CAST(least(100, CASE WHEN v1 >= v0 * 10 THEN 45 WHEN v1 >= v0 * 5 THEN 35 WHEN v1 >= v0 * 3 THEN 25 ELSE 0 END + CASE
               WHEN amendments >= 3 THEN 15 WHEN amendments >= 1 THEN 10 ELSE 0 END + CASE WHEN v1 - v0 >= 1000000 THEN 15
               WHEN v1 - v0 >= 100000 THEN 8 ELSE 0 END + CASE WHEN near THEN 15 ELSE 0 END) AS BIGINT) AS score,
           concat_ws('; ', CASE WHEN v1 >= v0 * 3 THEN 'value grew at least threefold' END, CASE
               WHEN NOT ia THEN 'latest row is not an amendment' END, CASE WHEN amendments >= 3 THEN 'three or more amendments' END, CASE
               WHEN v1 - v0 >= 1000000 THEN 'increase of a million or more' END, CASE
               WHEN near THEN 'first value just below a threshold' END) AS why_flagged FROM j""")
def amendment_creep(spark, d):
    return S.amendment_creep(view(spark, d, "agreements")).select("ref_number", "vendor", "original_value", "current_value", "amendment_count", "near_threshold", "score", "why_flagged")


@query("sole_source_followon", "O-193 O-224 O-140", f"""
    WITH c AS (SELECT upper(vendor) AS k, sum(amount) AS t, max(amount) AS m, count(*) AS n FROM {{contracts}} WHERE NOT sole_source AND amount > 0
        GROUP BY 1), s AS (SELECT upper(vendor) AS k, sum(amount) AS t, count(*) AS n, count(*) FILTER (WHERE situation = 'z') AS z FROM {{contracts}}
        WHERE sole_source AND amount > 0 GROUP BY 1),
    j AS (SELECT c.k, c.t AS ct, c.m, c.n AS cn, s.t AS st, s.n AS sn, z, {_NEAR.format(x='c.m')} AS near FROM c JOIN s ON c.k = s.k)
    SELECT 'ab:' || md5(trim(regexp_replace(k, '[^A-Z0-9]+', ' ', 'g'))) AS case_id, CAST(ct AS DOUBLE) AS competitive_total,
        CAST(st AS DOUBLE) AS sole_total, cn AS competitive_count, sn AS sole_count, z AS nonstandard_count,
           CAST(least(100, CASE WHEN st > ct THEN 35 ELSE 22 END + CASE WHEN sn >= 5 THEN 15 WHEN sn >= 2 THEN 10 ELSE 0 END + CASE WHEN z > 0 THEN 20
               ELSE 0 END + CASE WHEN cn >= 3 THEN 10 ELSE 0 END + CASE WHEN near THEN 15 ELSE 0 END) AS BIGINT) AS score
    FROM j WHERE (ct + st) / ct > 3 OR st > ct OR z > 0""")
def sole_source_followon(spark, d):
    return S.sole_source_followon(view(spark, d, "contracts")).select("case_id", "competitive_total", "sole_total", "competitive_count", "sole_count", "nonstandard_count", "score")


@query("program_dominance", "O-215 O-094", """
    SELECT recipient, count(*) AS programs_dominated, CAST(sum(v) AS DOUBLE) AS dominated_value
        FROM (SELECT program, department, recipient, sum(amount) AS v, sum(sum(amount)) OVER (PARTITION BY program,
        department) AS t FROM {agreements} WHERE NOT is_amendment AND amount > 0 GROUP BY 1, 2, 3) x
        WHERE t > 100000 AND CAST(v AS DOUBLE) / CAST(t AS DOUBLE) > 0.1 GROUP BY recipient""")
def program_dominance(spark, d):
    return S.program_dominance(view(spark, d, "agreements"), 0.1)


@query("risk_register", "O-214", """
    WITH dom AS (SELECT recipient, count(*) AS pd, sum(v) AS dv
        FROM (SELECT program, department, recipient, sum(amount) AS v, sum(sum(amount)) OVER (PARTITION BY program,
        department) AS t FROM {agreements} WHERE NOT is_amendment AND amount > 0 GROUP BY 1, 2, 3) x
        WHERE t > 100000 AND CAST(v AS DOUBLE) / CAST(t AS DOUBLE) > 0.1 GROUP BY recipient),
    e AS (SELECT recipient, bn, recipient_type, max(province) AS province, count(*) FILTER (WHERE NOT is_amendment) AS n,
        count(*) FILTER (WHERE is_amendment) AS am, count(DISTINCT department) AS deps, CAST(coalesce(sum(amount) FILTER (WHERE NOT is_amendment),
        0) AS DOUBLE) AS v, CAST(coalesce(sum(amount) FILTER (WHERE is_amendment), 0) AS DOUBLE) AS more, max(amount) AS largest,
        max(year(start_date)) AS y
        FROM {agreements} WHERE recipient_type NOT IN ('P', 'G', 'I') GROUP BY 1, 2, 3),
    k AS (SELECT e.*, coalesce(pd, 0) AS pd, dv, bn IS NULL AS nobn, recipient_type = 'F' AS co FROM e LEFT JOIN dom USING (recipient) WHERE v >= 100000),
    s AS (SELECT recipient, bn, recipient_type, n, v,
        least(5, CASE WHEN y <= 1999 AND v >= 1000000 THEN 2 WHEN y <= 2000 AND v >= 1000000 THEN 1 ELSE 0 END + CASE WHEN n <= 3 AND v >= 500000
            AND y <= 2000 THEN 2 ELSE 0 END + CASE WHEN n = 1 AND v >= 1000000 AND y <= 2001 THEN 1 ELSE 0 END) AS cessation,
        least(5, CASE WHEN nobn AND co THEN 3 WHEN nobn THEN 1 ELSE 0 END + CASE WHEN province IS NULL THEN 1 ELSE 0 END + CASE WHEN nobn AND n <= 2
            AND v >= 500000 THEN 1 ELSE 0 END) AS identity,
        CASE WHEN am > 0 THEN CASE WHEN am >= 3 * greatest(n, 1) THEN 2 WHEN am >= greatest(n, 1) THEN 1 ELSE 0 END + CASE WHEN more > v * 2 THEN 2
            WHEN more > v THEN 1 ELSE 0 END ELSE 0 END AS amendment,
        least(5, CASE WHEN pd >= 3 THEN 3 WHEN pd >= 1 THEN 2 ELSE 0 END + CASE WHEN dv >= 100000000 THEN 2 ELSE 0 END) AS concentration,
        least(5, CASE WHEN n = 1 AND v >= 5000000 THEN 3 WHEN n <= 2 AND v >= 1000000 THEN 2 ELSE 0 END + CASE WHEN deps = 1 AND v >= 10000000 THEN 2
            WHEN deps = 1 AND v >= 1000000 THEN 1 ELSE 0 END) AS dependency,
        least(5, CASE WHEN largest >= 1000000000 THEN 3 WHEN largest >= 100000000 THEN 2 WHEN largest >= 10000000 THEN 1 ELSE 0 END + CASE WHEN n <= 2
            AND v / n >= 50000000 THEN 2 WHEN n <= 3 AND v / n >= 10000000 THEN 1 ELSE 0 END) AS scale FROM k),
    t AS (SELECT *, cessation + identity + amendment + concentration + dependency + scale AS score FROM s)
    SELECT recipient, bn, recipient_type, n AS grant_count, v AS total_value, CAST(cessation AS BIGINT) AS cessation,
        CAST(identity AS BIGINT) AS identity, CAST(amendment AS BIGINT) AS amendment, CAST(concentration AS BIGINT) AS concentration,
        CAST(dependency AS BIGINT) AS dependency, CAST(scale AS BIGINT) AS scale, CAST(score AS BIGINT) AS score,
           CASE WHEN score >= 15 THEN 'CRITICAL' WHEN score >= 10 THEN 'HIGH' WHEN score >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM t""")
def risk_register(spark, d):
    return S.risk_register(view(spark, d, "agreements"), 100_000, (1999, 2000, 2001), 0.1)


_GRANTED = "(SELECT c_custkey AS bn, year(start_date) AS year, CAST(amount AS DECIMAL(18,2)) AS amount FROM {agreements} WHERE NOT is_amendment)"


@query("reconcile_yearly", "O-218 O-062", f"""
    WITH g AS (SELECT bn, year, sum(amount) AS granted FROM {_GRANTED} a GROUP BY 1, 2
        HAVING sum(amount) >= 50000), f AS (SELECT filer AS bn, year, max(a) AS revenue FROM {{filings}} GROUP BY 1, 2),
    j AS (SELECT g.bn, g.year, granted, coalesce((SELECT max(revenue) FROM f
        WHERE f.bn = g.bn AND f.year BETWEEN g.year - 1 AND g.year + 1), 0) AS reported FROM g WHERE g.bn IN (SELECT bn FROM f))
    SELECT bn, CAST(year AS BIGINT) AS year, CAST(granted AS DOUBLE) AS granted, CAST(reported AS DOUBLE) AS reported, CASE
        WHEN reported = 0 THEN 'REPORTS_ZERO' WHEN CAST(granted AS DOUBLE) / CAST(reported AS DOUBLE) <= 1.1 THEN 'RECONCILED'
        WHEN CAST(granted AS DOUBLE) / CAST(reported AS DOUBLE) <= 2 THEN 'SLIGHTLY_HIGHER' ELSE 'MUCH_HIGHER' END AS flag FROM j""")
def reconcile_yearly(spark, d):
    g = view(spark, d, "agreements").where("not is_amendment").select(F.col("c_custkey").alias("bn"), F.year("start_date").alias("year"), "amount")
    return S.reconcile_yearly(g, view(spark, d, "filings").select(F.col("filer").alias("bn"), "year", F.col("a").alias("revenue")))


@query("reconcile_cumulative", "O-219 O-063", f"""
    WITH g AS (SELECT bn, sum(amount) AS granted FROM {_GRANTED} a GROUP BY 1
        HAVING sum(amount) >= 100000), y AS (SELECT filer AS bn, year, max(a) AS revenue, max(c) AS deferred FROM {{filings}} GROUP BY 1, 2),
    f AS (SELECT bn, sum(coalesce(revenue, 0)) AS reported, max(deferred) - min(deferred) AS dc, arg_max(deferred, year) AS ld FROM y
        GROUP BY 1), j AS (SELECT g.bn, granted, reported, ld, reported + greatest(coalesce(dc, 0), 0) AS e FROM g
        JOIN f USING (bn)), r AS (SELECT *, CASE WHEN e = 0 THEN 1e300 ELSE CAST(granted AS DOUBLE) / CAST(e AS DOUBLE) END AS q FROM j)
    SELECT bn, CAST(granted AS DOUBLE) AS granted, CAST(e AS DOUBLE) AS effective, CASE WHEN reported = 0 AND coalesce(ld, 0) = 0 THEN 'REPORTS_ZERO'
        WHEN q <= 1.15 THEN 'RECONCILED' WHEN q <= 2 THEN 'MODERATELY_HIGHER' WHEN q <= 5 THEN 'MUCH_HIGHER' ELSE 'EXTREMELY_HIGHER' END AS flag
        FROM r""")
def reconcile_cumulative(spark, d):
    g = view(spark, d, "agreements").where("not is_amendment").select(F.col("c_custkey").alias("bn"), "amount")
    f = view(spark, d, "filings").select(F.col("filer").alias("bn"), "year", F.col("a").alias("revenue"), F.col("c").alias("deferred"))
    return S.reconcile_cumulative(g, f).select("bn", "granted", "effective", "flag")


@query("governance_pairs", "O-177 O-178 O-205 O-089", """
    WITH r AS (SELECT org, person, min(year) AS y0, max(year) AS y1 FROM {roles}
        GROUP BY 1, 2), p AS (SELECT a.org AS org_a, b.org AS org_b, count(*) AS shared_people, min(greatest(a.y0, b.y0)) AS f, max(least(a.y1,
        b.y1)) AS l FROM r a JOIN r b ON a.person = b.person AND a.org < b.org GROUP BY 1, 2 HAVING count(*) >= 2),
    m AS (SELECT s_suppkey AS org, sum(amount) AS funding FROM {contracts}
        GROUP BY 1), j AS (SELECT p.*, coalesce(x.funding, 0) + coalesce(y.funding, 0) AS t FROM p LEFT JOIN m x ON x.org = org_a
        LEFT JOIN m y ON y.org = org_b)
    SELECT org_a, org_b, shared_people, CAST(t AS DOUBLE) AS joint_funding, CAST(CASE WHEN l >= f THEN l - f + 1 ELSE 0 END AS BIGINT) AS overlap_years,
           CAST(CASE WHEN shared_people >= 10 THEN 5 WHEN shared_people >= 5 THEN 4 WHEN shared_people >= 3 THEN 3 WHEN shared_people >= 2 THEN 2
               ELSE 1 END + CASE WHEN t >= 100000000 THEN 5 WHEN t >= 10000000 THEN 4 WHEN t >= 1000000 THEN 3 WHEN t >= 100000 THEN 2 ELSE 1 END +
               CASE WHEN l >= f THEN 2 ELSE 0 END AS BIGINT) AS score FROM j""")
def governance_pairs(spark, d):
    funding = view(spark, d, "contracts").groupBy(F.col("s_suppkey").alias("org")).agg(F.sum("amount").alias("funding"))
    return S.governance_score(G.shared_people(view(spark, d, "roles")), funding).select("org_a", "org_b", "shared_people", "joint_funding", "overlap_years", "score")


@query("person_rollup", "O-179", """
    SELECT person, count(DISTINCT org) AS orgs, CAST(min(year) AS BIGINT) AS first_year, CAST(max(year) AS BIGINT) AS last_year, count(*) AS roles
        FROM {roles} GROUP BY person HAVING count(DISTINCT org) >= 2""")
def person_rollup(spark, d):
    return view(spark, d, "roles").groupBy("person").agg(F.countDistinct("org").alias("orgs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("roles")).where("orgs >= 2")


_CELLS = """WITH t AS (SELECT department, program, vendor, sum(amount) AS dollars FROM {agreements} GROUP BY 1, 2, 3 HAVING sum(amount) > 0), s AS (SELECT *, CAST(dollars AS DOUBLE) / CAST(sum(dollars) OVER (PARTITION BY department, program) AS DOUBLE) AS share, row_number() OVER (PARTITION BY department, program ORDER BY dollars DESC, vendor) AS rank FROM t),
    c AS (SELECT department, program, count(*) AS entity_count, CAST(sum(dollars) AS DOUBLE) AS total_dollars, sum(share * share) AS h, sum(CASE
        WHEN rank <= 4 THEN share ELSE 0 END) AS c4, max(share) AS ts, sum(share) AS ss, string_agg(CASE WHEN rank <= 5 THEN vendor END, '; '
        ORDER BY rank) AS top_entities FROM s GROUP BY 1, 2)"""


@query("hhi_cells", "O-200 O-201 O-263 O-091", _CELLS + """
    SELECT department, program, entity_count, total_dollars, round(h, 8) AS hhi, round(c4, 8) AS cr4, round(ts, 8) AS top_share, round(1 / h,
        6) AS effective_competitors, top_entities, abs(ss - 1) <= 0.001 AND h BETWEEN 0 AND 1.000000001 AND c4 BETWEEN 0 AND 1.000000001
        AND ts BETWEEN 0 AND 1.000000001 AND 1 / h >= 0.999999999 AS valid FROM c""")
def hhi_cells(spark, d):
    c = A.concentration(view(spark, d, "agreements"), ["department", "program"], "vendor", "amount")
    return c.select("department", "program", "entity_count", "total_dollars", *(F.round(x, 8).alias(x) for x in ("hhi", "cr4", "top_share")), F.round("effective_competitors", 6).alias("effective_competitors"), "top_entities", A.concentration_ok().alias("valid"))


def flagship(spark, d):
    """Concentration of spending by department and program."""
    return hhi_cells(spark, d)


@query("hhi_levels", "O-202 O-203", """
    WITH t AS (SELECT department, vendor, sum(amount) AS a FROM {agreements}
        GROUP BY 1, 2), s AS (SELECT department,
        CAST(a AS DOUBLE) / CAST(sum(a) OVER (PARTITION BY department) AS DOUBLE) AS p FROM t) SELECT department, round(sum(p * p) * 10000, 4) AS hhi,
        CASE WHEN sum(p * p) * 10000 > 2500 THEN 'HIGH' WHEN sum(p * p) * 10000 > 1500 THEN 'MODERATE' ELSE 'LOW' END AS level FROM s GROUP BY 1""")
def hhi_levels(spark, d):
    c = A.concentration(view(spark, d, "agreements"), ["department"], "vendor", "amount").withColumn("h", F.col("hhi") * 10_000)
    return c.select("department", F.round("h", 4).alias("hhi"), A.hhi_level(F.col("h")).alias("level"))


@query("recipient_breadth", "O-204", """
    SELECT recipient, count(DISTINCT department) AS departments, count(DISTINCT program) AS programs, CAST(sum(amount) AS DOUBLE) AS total,
        CAST(sum(amount) FILTER (WHERE sole_source) AS DOUBLE) AS sole_total FROM {agreements} WHERE recipient_type = 'F' GROUP BY recipient
        HAVING count(DISTINCT department) >= 3""")
def recipient_breadth(spark, d):
    a = view(spark, d, "agreements").where("recipient_type = 'F'")
    return a.groupBy("recipient").agg(F.countDistinct("department").alias("departments"), F.countDistinct("program").alias("programs"), F.sum("amount").alias("total"), A.sum_where(F.col("sole_source"), F.col("amount")).alias("sole_total")).where("departments >= 3")


@query("growth_decomposition", "O-208", """
    WITH y AS (SELECT program, year(start_date) AS yr, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS p FROM {agreements} GROUP BY 1, 2)
    SELECT b.program, CAST(b.yr AS BIGINT) AS yr, round((b.n - a.n) * a.p, 2) AS volume_effect, round(a.n * (b.p - a.p), 2) AS value_effect,
        round((b.n - a.n) * (b.p - a.p), 2) AS interaction_effect FROM y a JOIN y b ON a.program = b.program AND b.yr = a.yr + 1""")
def growth_decomposition(spark, d):
    y = view(spark, d, "agreements").groupBy("program", F.year("start_date").alias("yr")).agg(F.count("*").alias("n"), F.sum("amount").alias("t")).withColumn("p", V.ratio(F.col("t"), F.col("n")))
    before = y.select("program", (F.col("yr") + 1).alias("yr"), F.col("n").alias("n0"), F.col("p").alias("p0"))
    parts = A.growth_parts(F.col("n0"), F.col("p0"), F.col("n"), F.col("p"))
    return before.join(y, ["program", "yr"]).select("program", "yr", *(F.round(c, 2).alias(k) for k, c in parts.items()))


@query("quarter_spike", "O-225 O-251 O-083", """
    SELECT department, CAST(sum(amount) FILTER (WHERE month(start_date) <= 3) AS DOUBLE) AS last_quarter, CAST(sum(amount) AS DOUBLE) AS total,
        round(CAST(sum(amount) FILTER (WHERE month(start_date) <= 3) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS share FROM {agreements}
        GROUP BY department""")
def quarter_spike(spark, d):
    g = view(spark, d, "agreements").groupBy("department").agg(A.sum_where(V.fiscal_quarter(F.col("start_date")) == 4, F.col("amount")).alias("last_quarter"), F.sum("amount").alias("total"))
    return g.withColumn("share", F.round(V.ratio(F.col("last_quarter"), F.col("total")), 6))


@query("new_and_loyal", "O-088", """
    WITH f AS (SELECT recipient, year(start_date) AS y, min(year(start_date)) OVER (PARTITION BY recipient) AS y0,
        count(DISTINCT year(start_date)) OVER (PARTITION BY recipient) AS years, amount FROM {agreements})
    SELECT CAST(y AS BIGINT) AS y, count(DISTINCT recipient) AS recipients, count(DISTINCT CASE WHEN y = y0 THEN recipient END) AS new_recipients,
        count(DISTINCT CASE WHEN years >= 5 THEN recipient END) AS loyal, CAST(sum(amount) AS DOUBLE) AS total FROM f GROUP BY y""")
def new_and_loyal(spark, d):
    per = view(spark, d, "agreements").groupBy("recipient", F.year("start_date").alias("y")).agg(F.sum("amount").alias("amount"))
    span = per.groupBy("recipient").agg(F.min("y").alias("y0"), F.count("*").alias("years"))
    j = per.join(span, "recipient")
    return j.groupBy("y").agg(F.count("*").alias("recipients"), A.count_where(F.col("y") == F.col("y0")).alias("new_recipients"), A.count_where(F.col("years") >= 5).alias("loyal"), F.sum("amount").alias("total"))


@query("survival", "O-226 O-250", """
    SELECT CAST(floor(year(registered) / 10) * 10 AS BIGINT) AS decade, count(*) AS registered_count,
        count(*) FILTER (WHERE status = 'ACTIVE') AS active, round(avg(CASE WHEN status = 'ACTIVE' THEN 1.0 ELSE 0.0 END), 6) AS survival,
        CAST(max(date_diff('month', registered, DATE '2001-08-01') - CASE WHEN day(registered) > 1 THEN 1 ELSE 0 END) // 12 AS BIGINT) AS oldest_years
        FROM {registry} GROUP BY 1""")
def survival(spark, d):
    r = view(spark, d, "registry")
    decade = (F.floor(F.year("registered") / 10) * 10).cast("bigint")
    return r.groupBy(decade.alias("decade")).agg(F.count("*").alias("registered_count"), A.count_where(F.col("status") == "ACTIVE").alias("active"), F.round(F.avg(V.flag(F.col("status") == "ACTIVE", 1)), 6).alias("survival"), F.max(V.years_between(F.col("registered"), F.lit(AS_OF).cast("date"))).alias("oldest_years"))


@query("provincial_equity", "O-212 O-240", """
    WITH p AS (SELECT province, CAST(sum(amount) AS DOUBLE) AS total FROM {agreements}
        GROUP BY 1), n AS (SELECT n_name AS province, count(*) AS people FROM customer JOIN nation ON n_nationkey = c_nationkey
        GROUP BY 1), j AS (SELECT province, total, people, total / people AS per_head FROM p JOIN n USING (province))
    SELECT province, total, people, round(per_head, 4) AS per_head, round(per_head / (SELECT sum(total) / sum(people) FROM j) - 1, 6) AS deviation FROM j""")
def provincial_equity(spark, d):
    p = view(spark, d, "agreements").groupBy("province").agg(F.sum("amount").alias("total"))
    c, n = view(spark, d, "customer"), view(spark, d, "nation")
    people = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people")).join(n, "n_nationkey").select(F.col("n_name").alias("province"), "people")
    j = p.join(people, "province").withColumn("per_head", V.ratio(F.col("total"), F.col("people")))
    whole = F.broadcast(j.agg(F.sum("total").alias("t"), F.sum("people").alias("n")))  # one row
    return j.crossJoin(whole).select("province", "total", "people", F.round("per_head", 4).alias("per_head"), F.round(F.col("per_head") / V.ratio(F.col("t"), F.col("n")) - 1, 6).alias("deviation"))


@query("contract_patterns", "O-223 O-224", """
    SELECT vendor, CAST(start_date AS VARCHAR) AS start_date, count(*) AS same_day, CAST(sum(amount) AS DOUBLE) AS amount,
        count(*) FILTER (WHERE amount BETWEEN 9500 AND 10000) AS just_below FROM {contracts} WHERE sole_source GROUP BY vendor, start_date
        HAVING count(*) >= 2""")
def contract_patterns(spark, d):
    c = view(spark, d, "contracts").where("sole_source")
    return c.groupBy("vendor", "start_date").agg(F.count("*").alias("same_day"), F.sum("amount").alias("amount"), A.count_where(F.col("amount").between(9500, 10000)).alias("just_below")).where("same_day >= 2")


@query("defunct_recipients", "O-223 O-047", """
    WITH s AS (SELECT vendor, sum(amount) FILTER (WHERE sole_source) AS sole, sum(amount) FILTER (WHERE NOT sole_source) AS competitive,
        max(start_date) AS last FROM {contracts} GROUP BY 1)
    SELECT name, status, CAST(sole AS DOUBLE) AS sole, CAST(competitive AS DOUBLE) AS competitive, CAST(last AS VARCHAR) AS last FROM {registry}
        LEFT JOIN s ON vendor = name WHERE status <> 'ACTIVE'""")
def defunct_recipients(spark, d):
    c = view(spark, d, "contracts")
    s = c.groupBy(F.col("vendor").alias("name")).agg(A.sum_where(F.col("sole_source"), F.col("amount")).alias("sole"), A.sum_where(~F.col("sole_source"), F.col("amount")).alias("competitive"), F.max("start_date").alias("last"))
    return view(spark, d, "registry").where("status <> 'ACTIVE'").join(s, "name", "left").select("name", "status", "sole", "competitive", "last")


@query("priority_queue", "O-263", _CELLS + """
    , q AS (SELECT 'concentration' AS module, department || '/' || program AS case_id, CAST(least(100, round(h * 70 + ts * 25 + CASE
        WHEN entity_count <= 9 THEN 5 ELSE 0 END)) AS BIGINT) AS score FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, case_id) AS turn FROM q) SELECT module, case_id, score,
        CASE WHEN score >= 81 THEN 'high' WHEN score >= 51 THEN 'medium' ELSE 'low' END AS band, turn FROM r WHERE turn <= 50""")
def priority_queue(spark, d):
    c = A.concentration(view(spark, d, "agreements"), ["department", "program"], "vendor", "amount")
    q = c.select(F.lit("concentration").alias("module"), F.concat_ws("/", "department", "program").alias("case_id"), S.concentration_priority(F.col("hhi"), F.col("top_share"), F.col("entity_count")).alias("score"))
    q = q.withColumn("band", S.level_of(F.col("score"), [(81, "high"), (51, "medium")], "low"))
    return K.top_per_group(q, ["module"], [F.col("score").desc(), F.col("case_id")], 50, "turn")


@query("readiness", "O-247", """
    SELECT event_type, count(*) AS cases, round(avg(CASE WHEN value IS NOT NULL AND props IS NOT NULL AND length(props) > 2 THEN 1.0 ELSE 0.0 END),
        6) AS ready_share, avg(CASE WHEN value IS NOT NULL AND props IS NOT NULL AND length(props) > 2 THEN 1.0 ELSE 0.0 END) >= 0.9 AS ready,
        count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')) AS related FROM events
        GROUP BY event_type""")
def readiness(spark, d):
    e = view(spark, d, "events")
    errors = e.where("event_type = 'error'").select("user_id").distinct().withColumn("hit", F.lit(True))
    ok = V.flag(F.col("value").isNotNull() & F.col("props").isNotNull() & (F.length("props") > 2), 1)
    g = e.join(errors, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("cases"), F.avg(ok).alias("s"), F.countDistinct(F.when(F.col("hit"), F.col("user_id"))).alias("related"))
    return g.select("event_type", "cases", F.round("s", 6).alias("ready_share"), (F.col("s") >= 0.9).alias("ready"), "related")


@query("overhead", "O-211", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS filings, CAST(sum(total) AS DOUBLE) AS total,
        round(CAST(sum(compensation) AS DOUBLE) / nullif(CAST(sum(program_spending + compensation) AS DOUBLE), 0), 6) AS overhead,
        count(*) FILTER (WHERE total > 400000) AS outliers FROM {filings} GROUP BY year""")
def overhead(spark, d):
    f = view(spark, d, "filings")
    g = f.groupBy("year").agg(F.count("*").alias("filings"), F.sum("total").alias("total"), F.sum("compensation").alias("c"), F.sum(F.col("program_spending") + F.col("compensation")).alias("s"), A.count_where(F.col("total") > 400000).alias("outliers"))
    return g.select("year", "filings", "total", F.round(V.ratio(F.col("c"), F.col("s")), 6).alias("overhead"), "outliers")


_SUMMARY = f"""s AS (SELECT recipient_key, CAST(total_value AS DOUBLE) AS total_value, greatest(2001 - last_year, 0) AS since, grant_count, last_amendment_date IS NULL OR year(last_amendment_date) < {QUIET} AS quiet,
        recipient_type = 'F' AND last_year < {GONE} AND total_value >= 1000000 AS gone, last_year < {QUIET} AND total_value >= 500000 AS zombie, grant_count BETWEEN 1 AND 2 AND total_value >= 1000000 AS dep FROM {{recipients}}),
    z AS (SELECT recipient_key, total_value, CAST(since AS BIGINT) AS years_since, CASE WHEN gone THEN 'disappeared_for_profit' WHEN zombie THEN 'zombie' ELSE 'high_dependency' END AS signal,
        concat_ws(',', CASE WHEN gone THEN 'disappeared_for_profit' END, CASE WHEN zombie THEN 'zombie' END, CASE WHEN dep THEN 'high_dependency' END) AS signals,
        CAST(CASE WHEN since >= 8 THEN 7 WHEN since >= 5 THEN 5 WHEN since >= 3 THEN 3 ELSE 1 END + {_VALUE} + CASE WHEN grant_count <= 1 THEN 3 WHEN grant_count <= 2 THEN 2 WHEN grant_count <= 5 THEN 1 ELSE 0 END
            + CASE WHEN quiet THEN 2 ELSE 0 END + CASE WHEN gone THEN 3 ELSE 0 END AS BIGINT) AS score FROM s WHERE gone OR zombie OR dep)"""


@query("zombie_summary", "O-260", f"WITH {_SUMMARY} SELECT * FROM z")
def zombie_summary(spark, d):
    return S.zombie_summary(S.recipient_rollup(view(spark, d, "agreements")), 2001, QUIET, GONE)


@query("zombie_counts", "O-184", f"WITH {_SUMMARY} SELECT signal, count(*) AS recipients, round(sum(total_value), 2) AS total_value, count(*) FILTER (WHERE score >= 10) AS high FROM z GROUP BY 1")
def zombie_counts(spark, d):
    c = S.signal_counts(S.zombie_summary(S.recipient_rollup(view(spark, d, "agreements")), 2001, QUIET, GONE), 10)
    return c.withColumn("total_value", F.round(F.col("total_value").cast("double"), 2))


@query("growth_priority", "O-264", """
    WITH y AS (SELECT department, year(start_date) AS yr, CAST(sum(amount) AS DOUBLE) AS t, CAST(coalesce(sum(amount) FILTER (WHERE is_amendment), 0) AS DOUBLE) AS a FROM {agreements} GROUP BY 1, 2),
    v AS (SELECT department, year(start_date) AS yr, vendor, CAST(sum(amount) AS DOUBLE) AS x FROM {agreements} GROUP BY 1, 2, 3),
    h AS (SELECT department, yr, sum(pow(x / t, 2)) AS hhi FROM v JOIN y USING (department, yr) GROUP BY 1, 2)
    SELECT b.department, CAST(b.yr AS BIGINT) AS yr, round(b.t - p.t, 2) AS change, round(hhi, 6) AS hhi, round(b.a / b.t, 6) AS amendment_share,
        CAST(round(least(50.0, abs(b.t - p.t) / 10000000) + least(35.0, hhi * 35) + least(15.0, b.a / b.t * 15)) AS BIGINT) AS score
    FROM y b JOIN y p ON p.department = b.department AND p.yr = b.yr - 1 JOIN h ON h.department = b.department AND h.yr = b.yr""")
def growth_priority(spark, d):
    """Departments and years by change of spending, concentration on vendors and share of amendments."""
    from ledgerlark.sources.store import written

    v = view(spark, d, "agreements").groupBy("department", F.year("start_date").alias("yr"), "vendor").agg(F.sum("amount").alias("x"), F.sum(F.when(F.col("is_amendment"), F.col("amount"))).alias("a"))
    v = written(v, "vendors")
    y = v.groupBy("department", "yr").agg(F.sum("x").cast("double").alias("t"), F.coalesce(F.sum("a"), F.lit(0)).cast("double").alias("a"))
    h = v.join(y.select("department", "yr", "t"), ["department", "yr"]).groupBy("department", "yr").agg(F.sum(F.pow(F.col("x").cast("double") / F.col("t"), 2)).alias("hhi"))
    before = y.select("department", (F.col("yr") + 1).alias("yr"), F.col("t").alias("t0"))
    j = y.join(before, ["department", "yr"]).join(h, ["department", "yr"])
    change, share = F.col("t") - F.col("t0"), V.ratio(F.col("a"), F.col("t"))
    return j.select("department", "yr", F.round(change, 2).alias("change"), F.round("hhi", 6).alias("hhi"), F.round(share, 6).alias("amendment_share"), S.growth_priority(change, F.col("hhi"), share).alias("score"))
