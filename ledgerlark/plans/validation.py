"""Accounting rules, audits of names and numbers, and event-time extensions over the standard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.functions import values as V
from ledgerlark.operators import aggregate as A
from ledgerlark.operators import latest as L
from ledgerlark.operators import rules as R
from ledgerlark.sources import sinks as S
from ledgerlark.streaming import events as T

from .registry import query
from .views import view


@query("identity_rules", "O-232", """
    WITH f AS (SELECT filing, total AS t, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s, a IS NOT NULL OR b IS NOT NULL
        OR c IS NOT NULL AS has FROM {filings}) SELECT filing, 'total_of_parts' AS rule, CASE WHEN t IS NULL AND has THEN 'TOTAL_MISSING'
        WHEN t IS NOT NULL AND NOT has AND abs(t) > 1 THEN 'PARTS_MISSING' ELSE 'SUM_MISMATCH' END AS failure
    FROM f WHERE (t IS NULL AND has) OR (t IS NOT NULL AND NOT has AND abs(t) > 1) OR (t IS NOT NULL AND has AND abs(s - t) > 1)""")
def identity_rules(spark, d):
    return R.identity_violations(view(spark, d, "filings"), [R.Identity("total_of_parts", "total", ("a", "b", "c"))], ["filing"])


@query("partition_rule", "O-233", """
    SELECT filing, 'parts_within' AS rule, CASE WHEN total IS NULL THEN 'TOTAL_MISSING' WHEN a IS NULL AND b IS NULL THEN 'PARTS_MISSING'
        ELSE 'SUM_MISMATCH' END AS failure FROM {filings} WHERE (total IS NULL AND (a IS NOT NULL OR b IS NOT NULL)) OR (total IS NOT NULL
        AND a IS NULL AND b IS NULL AND abs(total) > 1) OR coalesce(a, 0) + coalesce(b, 0) - total > 1""")
def partition_rule(spark, d):
    return R.identity_violations(view(spark, d, "filings"), [R.Identity("parts_within", "total", ("a", "b"), one_sided=True)], ["filing"])


@query("schedule_equalities", "O-234", """
    SELECT o_orderkey AS filing, 'total' AS field, CAST(f.total AS DOUBLE) AS main_value,
        CAST(CAST(o_totalprice * 2 AS DECIMAL(18,2)) AS DOUBLE) AS schedule_value FROM {filings} f JOIN orders ON o_orderkey = filing
        WHERE o_orderpriority = '1-URGENT' AND abs(f.total - CAST(o_totalprice * 2 AS DECIMAL(18,2))) > 1""")
def schedule_equalities(spark, d):
    s = view(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("filing"), (F.col("o_totalprice") * 2).cast("decimal(18,2)").alias("stated"))
    return R.schedule_equalities(view(spark, d, "filings"), s, ["filing"], [("total", "stated")])


@query("schedule_dependency", "O-235", """
    SELECT filing, CASE WHEN c > 0 THEN 'SCHEDULE_MISSING' ELSE 'SCHEDULE_NOT_NEEDED' END AS problem FROM {filings} f
        LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) s ON s.k = filing
        WHERE (c > 0 AND k IS NULL) OR (coalesce(c, 0) <= 0 AND k IS NOT NULL)""")
def schedule_dependency(spark, d):
    s = view(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("filing"))
    return R.schedule_dependency(view(spark, d, "filings"), s, ["filing"], F.col("c") > 0)


@query("plausibility", "O-236", """
    SELECT filing, 'total' AS field, CAST(total AS DOUBLE) AS value FROM {filings} WHERE total > 450000 AND filer % 10 <> 0
        UNION ALL SELECT filing, 'a', CAST(a AS DOUBLE) FROM {filings} WHERE a > 450000 AND filer % 10 <> 0""")
def plausibility(spark, d):
    return R.implausible_fields(view(spark, d, "filings"), ["total", "a"], ["filing"], 450_000, F.col("filer") % 10 == 0)


@query("ratio_flags", "O-236 O-231", """
    SELECT filing, 'EXPENDITURE_OVER_REVENUE' AS flag FROM {filings} WHERE total > 0 AND program_spending > total * 2
        UNION ALL SELECT filing, 'COMPENSATION_OVER_EXPENDITURE' FROM {filings} WHERE program_spending > 0 AND compensation > program_spending""")
def ratio_flags(spark, d):
    return R.ratio_flags(view(spark, d, "filings"), ["filing"], "program_spending", "total", "compensation", 2)


@query("name_history", "O-102", """
    SELECT recipient_type, recipient, CAST(min(year(start_date)) AS BIGINT) AS first_year, CAST(max(year(start_date)) AS BIGINT) AS last_year,
        count(*) AS rows FROM {agreements} GROUP BY 1, 2 HAVING max(year(start_date)) - min(year(start_date)) >= 3""")
def name_history(spark, d):
    y = F.year("start_date")
    return view(spark, d, "agreements").groupBy("recipient_type", "recipient").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count("*").alias("rows")).where("last_year - first_year >= 3")


@query("latest_names", "O-102", """
    SELECT c_custkey AS k, recipient AS name FROM {agreements} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY start_date DESC NULLS LAST,
        line_id) = 1""")
def latest_names(spark, d):
    a = view(spark, d, "agreements").select(F.col("c_custkey").alias("k"), F.col("recipient").alias("name"), "start_date", "line_id")
    return L.latest_name(a, "k", "start_date", "line_id").select("k", "name")


@query("number_mismatches", "O-126", """
    SELECT CASE WHEN bn IS NULL THEN 'no_number' WHEN regexp_matches(bn, '^[0-9]+RR0001$') THEN 'charity' WHEN regexp_matches(bn,
        '^[0-9]+$') THEN 'digits_only' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT province) AS provinces FROM {dirty_names} GROUP BY 1""")
def number_mismatches(spark, d):
    bn = F.col("bn")
    kind = F.when(bn.isNull(), "no_number").when(bn.rlike("^[0-9]+RR0001$"), "charity").when(bn.rlike("^[0-9]+$"), "digits_only").otherwise("other")
    return view(spark, d, "dirty_names").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("province").alias("provinces"))


@query("value_cleaning", "O-240 O-241 O-050", """
    WITH m(code, label) AS (VALUES ('F', 'For-profit'), ('N', 'Non-profit'), ('G', 'Government')) SELECT coalesce(label, 'Unknown') AS label,
        upper(trim(department)) AS department, count(*) AS n FROM {agreements} LEFT JOIN m ON code = recipient_type GROUP BY 1, 2""")
def value_cleaning(spark, d):
    label = F.when(F.col("recipient_type") == "F", "For-profit").when(F.col("recipient_type") == "N", "Non-profit").when(F.col("recipient_type") == "G", "Government").otherwise("Unknown")
    return view(spark, d, "agreements").groupBy(label.alias("label"), F.upper(F.trim("department")).alias("department")).agg(F.count("*").alias("n"))


@query("ministry_history", "O-242", """
    WITH h AS (SELECT ministry, year(start_date) AS y, count(*) AS n FROM {contracts}
        GROUP BY 1, 2), v AS (SELECT ministry, y AS valid_from, lead(y) OVER (PARTITION BY ministry ORDER BY y) AS valid_to,
        n FROM h) SELECT ministry, CAST(valid_from AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to, n FROM v""")
def ministry_history(spark, d):
    from pyspark.sql import Window

    h = view(spark, d, "contracts").groupBy("ministry", F.year("start_date").alias("valid_from")).agg(F.count("*").alias("n"))
    return h.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("ministry").orderBy("valid_from")))


@query("unlinked_classes", "O-243", """
    SELECT CASE WHEN bn IS NOT NULL AND bn IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '1')
        FROM supplier) THEN 'bridged' WHEN bn IS NOT NULL THEN 'number_unknown' WHEN recipient_type = 'G' THEN 'government'
        ELSE 'no_number' END AS bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM {agreements} GROUP BY 1""")
def unlinked_classes(spark, d):
    a = view(spark, d, "agreements")
    s = view(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "1").alias("bn")).distinct().withColumn("there", F.lit(True))
    bucket = F.when(F.col("there"), "bridged").when(F.col("bn").isNotNull(), "number_unknown").when(F.col("recipient_type") == "G", "government").otherwise("no_number")
    return a.join(s, "bn", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("reference_defects", "O-244", """
    SELECT count(*) FILTER (WHERE n > 1) AS repeated_refs, count(*) FILTER (WHERE deps > 1) AS refs_of_many,
        count(*) FILTER (WHERE firsts = 0) AS without_first
        FROM (SELECT ref_number, count(*) AS n, count(DISTINCT department) AS deps, count(*) FILTER (WHERE NOT is_amendment) AS firsts
        FROM {agreements} GROUP BY 1) x""")
def reference_defects(spark, d):
    g = view(spark, d, "agreements").groupBy("ref_number").agg(F.count("*").alias("n"), F.countDistinct("department").alias("deps"), A.count_where(~F.col("is_amendment")).alias("firsts"))
    return g.agg(A.count_where(F.col("n") > 1).alias("repeated_refs"), A.count_where(F.col("deps") > 1).alias("refs_of_many"), A.count_where(F.col("firsts") == 0).alias("without_first"))


@query("record_timeline", "O-197 O-176", """
    SELECT CAST(start_date AS VARCHAR) AS day, 'agreement' AS kind, line_id AS id, CAST(amount AS DOUBLE) AS amount FROM {agreements}
        WHERE recipient = 'Customer#000000007' UNION ALL SELECT CAST(amendment_date AS VARCHAR), 'amendment', line_id, CAST(amount AS DOUBLE)
        FROM {agreements} WHERE recipient = 'Customer#000000007' AND is_amendment""")
def record_timeline(spark, d):
    a = view(spark, d, "agreements").where("recipient = 'Customer#000000007'")
    one = lambda rows, day, kind: rows.select(F.col(day).cast("string").alias("day"), F.lit(kind).alias("kind"), F.col("line_id").alias("id"), "amount")
    return one(a, "start_date", "agreement").unionByName(one(a.where("is_amendment"), "amendment_date", "amendment"))


@query("decision_log", "O-028 O-101", """
    WITH l AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'escalated' WHEN event_type = 'purchase' THEN 'cleared' ELSE 'in_review' END AS s,
        ts, event_id FROM events), o AS (SELECT user_id, s FROM l
        WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_id AS seq,
        l.user_id AS case_id, l.s AS status FROM l LEFT JOIN o USING (user_id) WHERE event_id % 2 = 1 AND (o.s IS NULL OR o.s <> l.s)""")
def decision_log(spark, d):
    s = F.when(F.col("event_type") == "error", "escalated").when(F.col("event_type") == "purchase", "cleared").otherwise("in_review")
    e = view(spark, d, "events").select(F.col("user_id").alias("case_id"), s.alias("status"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return S.append_decision(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")).select("seq", "case_id", "status")


@query("case_briefs", "O-029 O-257 O-261", "SELECT s_suppkey AS case_id, CASE WHEN s_acctbal < 0 THEN 'negative balance' END AS first_reason, s_name AS name FROM supplier")
def case_briefs(spark, d):
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("name"), F.array_join(V.reasons((F.col("s_acctbal") < 0, "negative balance")), "; ").alias("why"))
    b = S.briefs(s, ["name", "why"])
    return b.select("case_id", F.nullif(F.expr("variant_get(payload, '$.why', 'string')"), F.lit("")).alias("first_reason"), F.expr("variant_get(payload, '$.name', 'string')").alias("name"))


@query("sliding_windows", "streaming", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events
        FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE,
        time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS w FROM events) x
        GROUP BY 1""")
def sliding_windows(spark, d):
    return T.sliding(view(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "events")


@query("user_sessions", "streaming", """
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts,
        event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
        FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts),
        '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    return T.sessions(view(spark, d, "events"), "12 hours").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")
