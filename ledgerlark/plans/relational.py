"""Filters, joins, aggregates, windows, top-k and set operations over the standard views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import aggregate as A
from ledgerlark.operators import compare as C
from ledgerlark.operators import latest as L
from ledgerlark.operators import topk as K
from ledgerlark.sources import readers as R
from ledgerlark.sources import sinks as S

from ledgerlark.operators.exact import exact_percentiles

from .registry import query
from .views import view

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query("scan_predicates", "O-001 O-031 O-032 O-033 O-034 O-035 O-036 O-037 O-038", """
    SELECT o_orderkey, o_orderpriority, CAST(CASE WHEN o_totalprice >= 300000 THEN 5 WHEN o_totalprice >= 150000 THEN 3
        WHEN o_totalprice >= 50000 THEN 2 ELSE 1 END AS BIGINT) AS points FROM orders
    WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_orderpriority ILIKE '%urgent%' AND regexp_matches(o_orderpriority, '^[0-9]-')
        AND o_totalprice BETWEEN 1000 AND 400000 AND (o_orderstatus IN ('O', 'F') OR o_orderstatus IS NULL)""")
def scan_predicates(spark, d):
    o = view(spark, d, "orders")
    kept = o.where(~F.col("o_orderstatus").eqNullSafe("P") & F.col("o_orderpriority").ilike("%urgent%") & F.col("o_orderpriority").rlike("^[0-9]-") & F.col("o_totalprice").between(1000, 400000) & (F.col("o_orderstatus").isin("O", "F") | F.col("o_orderstatus").isNull()))
    return kept.select("o_orderkey", "o_orderpriority", V.banded(F.col("o_totalprice"), [(300000, 5), (150000, 3), (50000, 2)], 1).alias("points"))


@query("row_counts", "O-018 O-111", """
    SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
        UNION ALL SELECT 'events', count(*) FROM events""")
def row_counts(spark, d):
    return R.row_counts({n: view(spark, d, n) for n in ("orders", "lineitem", "events")})


@query("histogram", "O-039 O-071", """
    SELECT bucket, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(min(l_extendedprice) AS DOUBLE) AS smallest FROM (
        SELECT l_extendedprice, CASE WHEN l_extendedprice < 1000 THEN 'under 1K' WHEN l_extendedprice < 10000 THEN '1K-10K'
            WHEN l_extendedprice < 50000 THEN '10K-50K' ELSE '50K+' END AS bucket FROM lineitem) b GROUP BY bucket""")
def histogram(spark, d):
    x = F.col("l_extendedprice")
    b = F.when(x < 1000, "under 1K").when(x < 10000, "1K-10K").when(x < 50000, "10K-50K").otherwise("50K+")
    return view(spark, d, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.sum(x.cast("decimal(18,2)")).alias("total"), F.min(x).alias("smallest"))


@query("ranked_vocabulary", "O-040 O-109 O-103", """
    SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS BIGINT) AS priority_rank FROM orders
    ORDER BY priority_rank, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""")
def ranked_vocabulary(spark, d):
    r = K.vocabulary_rank(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("priority_rank")
    return K.top_rows(view(spark, d, "orders").withColumn("priority_rank", r), [F.col("priority_rank"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 100).select("o_orderkey", "priority_rank")


@query("null_profile", "O-046 O-042", """
    WITH f AS (SELECT * FROM {filings}), n AS (SELECT count(*) AS rows FROM f)
    SELECT 'total' AS column_name, rows, (SELECT count(*) FROM f WHERE total IS NULL) AS nulls, (SELECT count(total)
        FROM f) AS filled, round((SELECT count(total) FROM f) * 100.0 / rows, 4) AS filled_pct FROM n UNION ALL
    SELECT 'a', rows, (SELECT count(*) FROM f WHERE a IS NULL), (SELECT count(a) FROM f), round((SELECT count(a) FROM f) * 100.0 / rows, 4) FROM n UNION ALL
    SELECT 'c', rows, (SELECT count(*) FROM f WHERE c IS NULL), (SELECT count(c) FROM f), round((SELECT count(c) FROM f) * 100.0 / rows, 4) FROM n""")
def null_profile(spark, d):
    return A.null_profile(view(spark, d, "filings"), ["total", "a", "c"])


@query("safe_ratio", "O-044 O-045 O-255", """
    SELECT s_suppkey, round(TRY_CAST(s_acctbal AS DOUBLE) / nullif(CAST(s_suppkey % 3 AS DOUBLE), 0), 6) AS ratio, CAST(least(abs(floor(s_acctbal)),
        1000) AS BIGINT) AS capped, TRY_CAST(substr(s_name, 1, 3) AS BIGINT) AS no_number FROM supplier""")
def safe_ratio(spark, d):
    s = view(spark, d, "supplier")
    return s.select("s_suppkey", F.round(V.ratio(F.col("s_acctbal"), F.col("s_suppkey") % 3), 6).alias("ratio"), F.least(F.abs(F.floor("s_acctbal")), F.lit(1000)).alias("capped"), F.substring("s_name", 1, 3).try_cast("bigint").alias("no_number"))


@query("distinct_rows", "O-043 O-087 O-042", """
    SELECT count(*) AS pairs, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment
        FROM customer) x""")
def distinct_rows(spark, d):
    c = view(spark, d, "customer")
    return c.agg(F.countDistinct(F.struct("c_nationkey", "c_mktsegment")).alias("pairs"), F.countDistinct("c_mktsegment").alias("segments"))


@query("except_columns", "O-041 O-049 O-051", """
    SELECT s_suppkey, s_name, n_name, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS code FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3""")
def except_columns(spark, d):
    s, n = view(spark, d, "supplier"), view(spark, d, "nation")
    return s.join(n, (n.n_nationkey == s.s_nationkey) & (n.n_regionkey < 3), "left").withColumn("code", F.lpad(F.col("s_nationkey").cast("string"), 4, "0")).drop("s_acctbal", "s_nationkey", "n_nationkey", "n_regionkey")


@query("normalised_join", "O-047 O-048 O-070", """
    SELECT count(*) AS lines, CAST(sum(amount) AS DOUBLE) AS total, province FROM (SELECT upper(trim(vendor)) AS k, amount FROM {contracts}) c
        JOIN (SELECT upper(trim(name)) AS k, province FROM {registry}) r USING (k) GROUP BY province""")
def normalised_join(spark, d):
    c = view(spark, d, "contracts").withColumn("k", F.upper(F.trim("vendor")))
    r = view(spark, d, "registry").withColumn("k", F.upper(F.trim("name")))
    return c.groupBy("k").agg(F.count("*").alias("n"), F.sum("amount").alias("a")).join(r, "k").groupBy("province").agg(F.sum("n").alias("lines"), F.sum("a").alias("total"))


@query("full_outer_rates", "O-052 O-223 O-225", """
    SELECT coalesce(g.k, c.k) AS department, CAST(coalesce(g.t, 0) AS DOUBLE) AS sole_total, CAST(coalesce(c.t, 0) AS DOUBLE) AS competitive_total,
        round(CAST(coalesce(g.t, 0) AS DOUBLE) / nullif(CAST(coalesce(g.t, 0) + coalesce(c.t, 0) AS DOUBLE), 0), 6) AS sole_rate
    FROM (SELECT ministry AS k, sum(amount) AS t FROM {contracts} WHERE sole_source AND start_date >= DATE '1998-01-01' GROUP BY 1) g
        FULL JOIN (SELECT ministry AS k, sum(amount) AS t FROM {contracts} WHERE NOT sole_source AND start_date < DATE '1997-01-01'
        GROUP BY 1) c ON g.k = c.k""")
def full_outer_rates(spark, d):
    c = view(spark, d, "contracts")
    g = c.where("sole_source and start_date >= date '1998-01-01'").groupBy(F.col("ministry").alias("department")).agg(F.sum("amount").alias("s"))
    k = c.where("not sole_source and start_date < date '1997-01-01'").groupBy(F.col("ministry").alias("department")).agg(F.sum("amount").alias("t"))
    j = g.join(k, "department", "full").fillna(0, ["s", "t"])
    return j.select("department", F.col("s").alias("sole_total"), F.col("t").alias("competitive_total"), F.round(V.ratio(F.col("s"), F.col("s") + F.col("t")), 6).alias("sole_rate"))


@query("lateral_top1", "O-054 O-068 O-069 O-077", """
    SELECT c_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, n FROM (
        SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC,
            o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) x WHERE rn = 1""")
def lateral_top1(spark, d):
    best = F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))
    return view(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(best.alias("b"), F.count("*").alias("n")).select("c_custkey", "b.o_orderkey", (-F.col("b.p")).alias("o_totalprice"), "n")


@query("unpivot_parts", "O-055 O-256", """
    SELECT part, count(value) AS filled, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT 'a' AS part, a AS value FROM {filings}
        UNION ALL SELECT 'b', b FROM {filings} UNION ALL SELECT 'c', c FROM {filings}) u GROUP BY part""")
def unpivot_parts(spark, d):
    return view(spark, d, "filings").unpivot("filing", ["a", "b", "c"], "part", "value").groupBy("part").agg(F.count("value").alias("filled"), F.sum("value").alias("total"))


@query("appeared_disappeared", "O-056 O-057 O-114", """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
    SELECT 'kept' AS status, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k) UNION ALL SELECT 'disappeared', count(*) FROM a
        WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k) UNION ALL SELECT 'appeared', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a
        WHERE a.k = b.k)""")
def appeared_disappeared(spark, d):
    o = view(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    a, b = (o.where(F.col("y") == y).select("k").distinct() for y in (1996, 1997))
    n = lambda rows, s: rows.agg(F.count("*").alias("n")).select(F.lit(s).alias("status"), "n")
    return n(a.join(b, "k", "left_semi"), "kept").union(n(C.only_in(a, b, ["k"]), "disappeared")).union(n(C.only_in(b, a, ["k"]), "appeared"))


@query("symmetric_self_join", "O-058 O-067 O-113", """
    SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def symmetric_self_join(spark, d):
    s = view(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id_a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("id_b"), "s_nationkey"), "s_nationkey").where("id_a < id_b").select("id_a", "id_b")


@query("yoy_growth", "O-060", """
    WITH y AS (SELECT province, year(start_date) AS yr, sum(amount) AS t FROM {agreements} GROUP BY 1, 2)
    SELECT a.province, CAST(b.yr AS BIGINT) AS yr, CAST(a.t AS DOUBLE) AS before, CAST(b.t AS DOUBLE) AS after,
        round(CAST(b.t - a.t AS DOUBLE) / CAST(a.t AS DOUBLE), 6) AS growth FROM y a JOIN y b ON a.province = b.province AND b.yr = a.yr + 1""")
def yoy_growth(spark, d):
    y = view(spark, d, "agreements").groupBy("province", F.year("start_date").alias("yr")).agg(F.sum("amount").alias("t"))
    j = y.select("province", (F.col("yr") + 1).alias("yr"), F.col("t").alias("before")).join(y.withColumnRenamed("t", "after"), ["province", "yr"])
    return j.withColumn("growth", F.round(V.ratio(F.col("after") - F.col("before"), F.col("before")), 6))


@query("filtered_aggregates", "O-072 O-073 O-074 O-079", """
    SELECT department, count(*) AS n, count(*) FILTER (WHERE is_amendment) AS amendments, count(DISTINCT CASE
        WHEN NOT is_amendment THEN recipient END) AS new_recipients, bool_or(sole_source) AS any_sole,
        CAST(sum(amount) FILTER (WHERE sole_source) AS DOUBLE) AS sole_amount
    FROM {agreements} GROUP BY department HAVING count(*) > 10 OR bool_or(amount > 50000)""")
def filtered_aggregates(spark, d):
    g = A.grouped(view(spark, d, "agreements"), ["department"], n=F.count("*"), amendments=A.count_where(F.col("is_amendment")), new_recipients=F.countDistinct(F.when(~F.col("is_amendment"), F.col("recipient"))), any_sole=F.bool_or("sole_source"), sole_amount=A.sum_where(F.col("sole_source"), F.col("amount")), big=F.bool_or(F.col("amount") > 50000))
    return g.where("n > 10 or big").drop("big")


@query("ordered_lists", "O-075 O-076 O-078", """
    SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, array_to_string(list_slice(list(n_name
        ORDER BY n_nationkey DESC), 1, 3), '|') AS last_three FROM nation GROUP BY n_regionkey""")
def ordered_lists(spark, d):
    last = F.array_join(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"]), 1, 3), "|")
    return view(spark, d, "nation").groupBy("n_regionkey").agg(A.distinct_list(F.col("n_name")).alias("names"), last.alias("last_three"))


@query("percentiles", "O-080 O-081 O-082 O-083 O-084 O-245", """
    SELECT l_returnflag, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.99), 4) AS p99, CAST(min(m) AS BIGINT) AS common_line,
        round(stddev_samp(x), 4) AS sd, round(stddev_samp(x) / avg(x), 6) AS cv FROM (
        SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x, first_value(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY n DESC,
            l_linenumber) AS m FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS n FROM lineitem) a) b GROUP BY l_returnflag""")
def percentiles(spark, d):
    x = F.col("l_extendedprice")
    li = view(spark, d, "lineitem")
    common = li.groupBy("l_returnflag", "l_linenumber").count().groupBy("l_returnflag").agg(F.min_by("l_linenumber", F.struct(-F.col("count"), "l_linenumber")).alias("common_line"))
    g = li.groupBy("l_returnflag").agg(F.round(F.stddev_samp(x), 4).alias("sd"), F.round(F.stddev_samp(x) / F.avg(x), 6).alias("cv"))
    p = exact_percentiles(li, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p99": 0.99})
    return g.join(common, "l_returnflag").join(p.select("l_returnflag", F.round("median", 4).alias("median"), F.round("p99", 4).alias("p99")), "l_returnflag")


@query("grouping_sets", "O-085 O-241", """
    SELECT department, fiscal_year, CASE WHEN grouping(fiscal_year) = 1 THEN 'all_years' ELSE 'by_fiscal_year' END AS aggregation_type,
        count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS total FROM (
        SELECT department, amount, CASE WHEN month(start_date) >= 4 THEN concat(CAST(year(start_date) AS VARCHAR), '-',
            CAST(year(start_date) + 1 AS VARCHAR)) ELSE concat(CAST(year(start_date) - 1 AS VARCHAR), '-',
            CAST(year(start_date) AS VARCHAR)) END AS fiscal_year FROM {agreements}) x
    GROUP BY GROUPING SETS ((department, fiscal_year), (department))""")
def grouping_sets(spark, d):
    a = view(spark, d, "agreements").withColumn("fiscal_year", V.fiscal_year(F.col("start_date")))
    return A.by_and_overall(a, ["department"], "fiscal_year", {"payments": F.count("*"), "total": F.sum("amount")})


@query("json_props", "O-086 O-257 O-066", """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
        count(DISTINCT json_extract_string(props, '$.k')) AS ks FROM events GROUP BY event_type""")
def json_props(spark, d):
    e = view(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("k").cast("bigint")).alias("k_sum"), F.countDistinct("k").alias("ks"))


@query("aggregate_of_aggregate", "O-088 O-090", """
    SELECT CAST(first_year AS BIGINT) AS first_year, count(*) AS recipients, CAST(sum(n) AS BIGINT) AS agreements
        FROM (SELECT o_custkey, min(year(o_orderdate)) AS first_year, count(*) AS n FROM orders GROUP BY o_custkey) x GROUP BY first_year""")
def aggregate_of_aggregate(spark, d):
    per = view(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.count("*").alias("n"))
    return per.groupBy("first_year").agg(F.count("*").alias("recipients"), F.sum("n").alias("agreements"))


@query("shares_of_total", "O-093 O-094 O-095 O-053 O-215", """
    SELECT program, recipient, CAST(t AS DOUBLE) AS total, round(CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY program) AS DOUBLE),
        8) AS program_share, round(CAST(t AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE), 8) AS overall_share
    FROM (SELECT program, recipient, sum(amount) AS t FROM {agreements} GROUP BY 1, 2) x QUALIFY CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY program) AS DOUBLE) > 0.001""")
def shares_of_total(spark, d):
    t = view(spark, d, "agreements").groupBy("program", "recipient").agg(F.sum("amount").alias("total"))
    s = A.with_grand_total(A.with_shares(t, "total", ["program"], "p", "p_total"), "total", "o", "o_total")
    return s.where("p > 0.001").select("program", "recipient", "total", F.round("p", 8).alias("program_share"), F.round("o", 8).alias("overall_share"))


@query("survivor_first_value", "O-097 O-091", """
    SELECT s_suppkey AS absorbed, survivor FROM (SELECT s_suppkey, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC,
        s_suppkey) AS survivor FROM supplier) x WHERE s_suppkey <> survivor""")
def survivor_first_value(spark, d):
    from ledgerlark.operators.entity import duplicate_survivors

    return duplicate_survivors(view(spark, d, "supplier").withColumn("k", F.col("s_nationkey").cast("string")), "k", order=[-F.col("s_acctbal")], id_col="s_suppkey")


CURRENT = "ROW_NUMBER() OVER (PARTITION BY ref_number, coalesce(bn, recipient, line_id) ORDER BY CAST(regexp_replace(amendment_number, '[^0-9]', '', 'g') AS INTEGER) DESC NULLS LAST, amendment_date DESC NULLS LAST, line_id DESC)"
ORIGINAL = "ROW_NUMBER() OVER (PARTITION BY ref_number, coalesce(bn, recipient, line_id) ORDER BY CAST(regexp_replace(amendment_number, '[^0-9]', '', 'g') AS INTEGER) NULLS FIRST, amendment_date NULLS FIRST, line_id)"


@query("current_agreements", "O-099 O-098 O-102", f"""
    SELECT ref_number, recipient, department, amendment_number, CAST(agreement_value AS DOUBLE) AS agreement_value
        FROM {{agreements}} QUALIFY {CURRENT} = 1""")
def current_agreements(spark, d):
    return L.current_agreements(L.with_agreement_key(view(spark, d, "agreements"))).select("ref_number", "recipient", "department", "amendment_number", "agreement_value")


@query("original_agreements", "O-100", f"""
    SELECT ref_number, recipient, department, CAST(agreement_value AS DOUBLE) AS agreement_value FROM {{agreements}}
        WHERE NOT is_amendment AND agreement_value > 0 QUALIFY {ORIGINAL} = 1""")
def original_agreements(spark, d):
    return L.original_agreements(L.with_agreement_key(view(spark, d, "agreements"))).select("ref_number", "recipient", "department", "agreement_value")


@query("largest_commitments", "O-099 O-106", f"""
    SELECT department, count(*) AS agreements, CAST(sum(agreement_value) AS DOUBLE) AS committed FROM (SELECT *
        FROM {{agreements}} QUALIFY {CURRENT} = 1) x GROUP BY department ORDER BY committed DESC, department LIMIT 10""")
def largest_commitments(spark, d):
    c = L.current_agreements(L.with_agreement_key(view(spark, d, "agreements")))
    return K.top_rows(c.groupBy("department").agg(F.count("*").alias("agreements"), F.sum("agreement_value").alias("committed")), [F.col("committed").desc(), F.col("department")], 10)


@query("agreement_sums", "O-198 O-099 O-100", f"""
    SELECT (SELECT CAST(sum(agreement_value) AS DOUBLE) FROM {{agreements}}) AS naive_sum, (SELECT CAST(sum(agreement_value) AS DOUBLE) FROM (SELECT *
        FROM {{agreements}} WHERE NOT is_amendment AND agreement_value > 0 QUALIFY {ORIGINAL} = 1) o) AS original_sum,
           (SELECT CAST(sum(agreement_value) AS DOUBLE) FROM (SELECT * FROM {{agreements}} QUALIFY {CURRENT} = 1) c) AS current_sum""")
def agreement_sums(spark, d):
    a = L.with_agreement_key(view(spark, d, "agreements"))
    s = lambda rows, n: rows.agg(F.sum("agreement_value").cast("decimal(38,2)").alias(n))
    return s(a, "naive_sum").crossJoin(s(L.original_agreements(a), "original_sum")).crossJoin(s(L.current_agreements(a), "current_sum"))


@query("latest_status", "O-101 O-028", """
    SELECT user_id AS case_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_status(spark, d):
    log = view(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return S.latest_status(log).select("case_id", "status")


@query("result_page", "O-104 O-096 O-196", """
    SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total_rows FROM customer
        WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50""")
def result_page(spark, d):
    c = view(spark, d, "customer").where("c_acctbal > 0")
    return K.page(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 50, 25).select("c_custkey", "c_acctbal").crossJoin(F.broadcast(c.agg(F.count("*").alias("total_rows"))))


@query("top_per_group", "O-105 O-092 O-204", """
    SELECT department, recipient, CAST(t AS DOUBLE) AS total, rank
        FROM (SELECT department, recipient, t, row_number() OVER (PARTITION BY department ORDER BY t DESC, recipient) AS rank FROM (SELECT department,
        recipient, sum(amount) AS t FROM {agreements} GROUP BY 1, 2) a) b WHERE rank <= 3""")
def top_per_group(spark, d):
    t = view(spark, d, "agreements").groupBy("department", "recipient").agg(F.sum("amount").alias("total"))
    return K.top_per_group(t, ["department"], [F.col("total").desc(), F.col("recipient")], 3)


@query("queue_interleave", "O-107 O-246", """
    SELECT event_id, event_type, place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC,
        event_id) AS place FROM events) x ORDER BY place, event_type LIMIT 60""")
def queue_interleave(spark, d):
    r = K.interleave(view(spark, d, "events"), "event_type", [F.col("value").desc(), F.col("event_id")], 60)
    return r.orderBy("place", "event_type").limit(60).select("event_id", "event_type", "place")


@query("balanced_selection", "O-108 O-206", """
    WITH r AS (SELECT p_partkey, p_brand, p_type, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC,
        p_partkey) = 1 AS f0, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) = 1 AS f1,
        row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) = 1 AS f2 FROM part)
    SELECT p_partkey, CAST(CASE WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 ELSE 3 END AS BIGINT) AS coverage_step
        FROM r ORDER BY coverage_step, p_retailprice DESC, p_partkey LIMIT 40""")
def balanced_selection(spark, d):
    return K.balanced(view(spark, d, "part"), [["p_brand"], ["p_type"], ["p_brand", "p_type"]], [F.col("p_retailprice").desc(), F.col("p_partkey")], 40, "p_partkey").select("p_partkey", "coverage_step")


@query("set_union", "O-111 O-112", """
    SELECT name, CAST(min(kind) AS VARCHAR) AS kind FROM (SELECT c_name AS name, 'c' AS kind FROM customer UNION SELECT s_name, 's' FROM supplier
        UNION SELECT c_name, 'c' FROM customer) u GROUP BY name""")
def set_union(spark, d):
    c = view(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind"))
    s = view(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"))
    return c.unionByName(s).distinct().groupBy("name").agg(F.min("kind").alias("kind"))


@query("compare_results", "O-115 O-239", """
    WITH a AS (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders WHERE o_orderkey % 50 <> 0
        GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders WHERE o_custkey % 40 <> 0
        GROUP BY 1),
    j AS (SELECT a.k AS ak, b.k AS bk, abs(CAST(a.n AS DOUBLE) - b.n) <= 1 OR abs(CAST(a.n AS DOUBLE) - b.n) / greatest(a.n, b.n, 1) <= 0.01 AS n_ok,
        abs(CAST(a.t AS DOUBLE) - CAST(b.t AS DOUBLE)) <= 1 OR abs(CAST(a.t AS DOUBLE) - CAST(b.t AS DOUBLE)) / greatest(abs(CAST(a.t AS DOUBLE)),
        abs(CAST(b.t AS DOUBLE)), 1) <= 0.01 AS t_ok FROM a FULL JOIN b ON a.k = b.k),
    c AS (SELECT count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND n_ok AND t_ok) AS matched, count(*) FILTER (WHERE ak IS NOT NULL
        AND bk IS NOT NULL AND NOT (n_ok AND t_ok)) AS differing, count(*) FILTER (WHERE bk IS NULL) AS only_a,
        count(*) FILTER (WHERE ak IS NULL) AS only_b FROM j)
    SELECT *, round(CAST(matched + differing AS DOUBLE) / (matched + differing + only_a + only_b), 6) AS overlap, CASE
        WHEN differing + only_a + only_b = 0 THEN 'pass' WHEN (matched + differing) * 1.0 / (matched + differing + only_a + only_b) >= 0.9
        AND differing = 0 THEN 'warning' ELSE 'fail' END AS verdict FROM c""")
def compare_results(spark, d):
    o = view(spark, d, "orders")
    side = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    return C.verdict(C.diff(side(o.where("o_orderkey % 50 <> 0")), side(o.where("o_custkey % 40 <> 0")), ["k"], ["n", "t"]))


@query("reload_check", "O-267 O-268", """
    WITH s AS (SELECT count(DISTINCT s_suppkey) AS k, count(*) AS r, count(s_acctbal) AS f, sum(CAST(s_acctbal AS DECIMAL(28,4))) AS t
        FROM supplier), b AS (SELECT count(DISTINCT s_suppkey) AS k, count(*) AS r, count(s_acctbal) AS f, sum(CAST(s_acctbal AS DECIMAL(28,4))) AS t
        FROM supplier WHERE s_suppkey % 10 <> 3)
    SELECT 'keys' AS measure, CAST(s.k AS DOUBLE) AS source_value, CAST(b.k AS DOUBLE) AS store_value, abs(s.k - b.k) <= greatest(5, s.k * 1e-4) AS ok
        FROM s, b UNION ALL SELECT 'rows', s.r, b.r, abs(s.r - b.r) <= greatest(5, s.r * 1e-4) FROM s, b UNION ALL
    SELECT 'filled:s_acctbal', s.f, b.f, abs(s.f - b.f) <= greatest(5, s.f * 1e-4) FROM s, b
        UNION ALL SELECT 'sum:s_acctbal', CAST(s.t AS DOUBLE), CAST(b.t AS DOUBLE), abs(s.t - b.t) <= greatest(1, abs(s.t) * 1e-4) FROM s, b""")
def reload_check(spark, d):
    s = view(spark, d, "supplier")
    return C.reload_check(C.profile(s, ["s_suppkey"], ["s_acctbal"]), C.profile(s.where("s_suppkey % 10 <> 3"), ["s_suppkey"], ["s_acctbal"]))


@query("upsert_merge", "O-020", """
    SELECT coalesce(e.s_suppkey, c.k) AS s_suppkey, coalesce(c.n, e.s_name) AS s_name, CAST(coalesce(c.b, e.s_acctbal) AS DOUBLE) AS s_acctbal
        FROM (SELECT * FROM supplier WHERE s_acctbal < 6000) e
        FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END AS n, s_acctbal + 1 AS b FROM supplier
        WHERE s_acctbal >= 3000) c ON e.s_suppkey = c.k""")
def upsert_merge(spark, d):
    s = view(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_acctbal >= 3000").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return S.upsert(s.where("s_acctbal < 6000"), new, ["s_suppkey"])


@query("delete_using", "O-024 O-025 O-243", """
    SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders
        WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def delete_using(spark, d):
    o = view(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return S.delete_using(S.keep_where_exists(view(spark, d, "customer").select("c_custkey"), o, ["c_custkey"]), o.where("o_orderpriority = '1-URGENT'"), ["c_custkey"])


@query("reversal_pairs", "O-244", """
    WITH x AS (SELECT vendor, amount, start_date, contract_number
        FROM {contracts}), k AS (SELECT vendor, amount, count(*) AS n, count(DISTINCT contract_number) AS contracts FROM x GROUP BY 1, 2
        HAVING count(*) > 1) SELECT vendor, CAST(amount AS DOUBLE) AS amount, n, contracts FROM k""")
def reversal_pairs(spark, d):
    return view(spark, d, "contracts").groupBy("vendor", "amount").agg(F.count("*").alias("n"), F.countDistinct("contract_number").alias("contracts")).where("n > 1")


@query("hourly_windows", "streaming", """
    SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value
        FROM events GROUP BY 1, 2""")
def hourly_windows(spark, d):
    from ledgerlark.streaming.events import tumbling

    return tumbling(view(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("sampled_filings", "O-269", "SELECT filing, filer, CAST(year AS BIGINT) AS year FROM {filings} WHERE ('0x' || left(md5(CAST(filing AS VARCHAR)), 8))::BIGINT % 20 = 0")
def sampled_filings(spark, d):
    return view(spark, d, "filings").where(V.sampled(F.col("filing"), 20)).select("filing", "filer", "year")


@query("person_window", "O-089 O-255 O-250", """
    SELECT org_a, org_b, CAST(greatest(a0, b0) AS BIGINT) AS overlap_first, CAST(least(a1, b1) AS BIGINT) AS overlap_last
        FROM (SELECT org AS org_a, min(year) AS a0, max(year) AS a1 FROM {roles} GROUP BY 1) a
        JOIN (SELECT org AS org_b, min(year) AS b0, max(year) AS b1 FROM {roles} GROUP BY 1) b ON org_b = org_a + 1""")
def person_window(spark, d):
    r = view(spark, d, "roles").groupBy("org").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    a, b = r.select(F.col("org").alias("org_a"), F.col("y0").alias("a0"), F.col("y1").alias("a1")), r.select(F.col("org").alias("org_b"), (F.col("org") - 1).alias("org_a"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    return a.join(b, "org_a").select("org_a", "org_b", F.greatest("a0", "b0").alias("overlap_first"), F.least("a1", "b1").alias("overlap_last"))
