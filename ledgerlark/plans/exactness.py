"""Reversals, histories of names, checksums of stores and gated loads over the standard views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.functions import values as V
from ledgerlark.operators import checksums as C
from ledgerlark.operators import exact as X
from ledgerlark.operators import history as H
from ledgerlark.sources import sinks as S
from ledgerlark.sources.store import shared_dir

from .names import _NORM
from .registry import query
from .views import view


@query("reversal_matches", "O-245", """
    WITH p AS (SELECT *, abs(amount) AS size, sign(amount) AS s, sum(sign(amount)) OVER (PARTITION BY vendor, abs(amount) ORDER BY day, id) AS run FROM {payments} WHERE amount <> 0),
    l AS (SELECT *, least(0, min(run) OVER (PARTITION BY vendor, size ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY vendor, size, s ORDER BY day, id) AS place FROM l WHERE s > 0 OR run >= coalesce(low, 0))
    SELECT a.vendor, a.size AS amount, a.id, b.id AS reversed_by FROM k a JOIN k b ON a.vendor = b.vendor AND a.size = b.size AND a.place = b.place AND a.s > 0 AND b.s < 0""")
def reversal_matches(spark, d):
    """Each payment with the one later payment that takes it back."""
    return X.matched_reversals(view(spark, d, "payments"), ["vendor"])


@query("ministry_valid_on", "O-242", """
    SELECT h.name, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS amount FROM {contracts} c JOIN supplier s USING (s_suppkey)
        LEFT JOIN {ministry_names} h ON h.ministry_id = s.s_nationkey AND c.start_date >= h.valid_from AND (h.valid_to IS NULL OR c.start_date < h.valid_to) GROUP BY 1""")
def ministry_valid_on(spark, d):
    """Contracts by the name that their ministry bore on the day."""
    c = view(spark, d, "contracts").join(view(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ministry_id")), "s_suppkey").select("ministry_id", "start_date", "amount")
    return H.valid_on(c, view(spark, d, "ministry_names"), ["ministry_id"], "start_date", ["name"]).groupBy("name").agg(F.count("*").alias("contracts"), F.sum("amount").alias("amount"))


_RUNS = """seen AS (SELECT bn, start_date AS day, min(name) AS name FROM {renamed} GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY bn ORDER BY day) = name THEN 0 ELSE 1 END AS fresh FROM seen),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY bn ORDER BY day) AS run FROM f),
    s AS (SELECT bn, run, min(name) AS name, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY 1, 2)"""


@query("name_spells", "O-238 O-102", f"WITH {_RUNS} SELECT bn, name, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, CAST(lead(first_day) OVER (PARTITION BY bn ORDER BY run) AS VARCHAR) AS valid_to FROM s")
def name_spells(spark, d):
    return H.spells(view(spark, d, "renamed"), "bn", "name", "start_date")


@query("rebrands", "O-238", f"""
    WITH named AS (SELECT bn, start_date, name, {_NORM} AS norm FROM {{renamed}}), shown AS (SELECT bn, norm, min(name) AS name FROM named GROUP BY 1, 2),
    {_RUNS.replace("min(name) AS name FROM {renamed}", "min(norm) AS name FROM named")},
    n AS (SELECT *, lead(name) OVER (PARTITION BY bn ORDER BY run) AS new, lead(first_day) OVER (PARTITION BY bn ORDER BY run) AS changed FROM s)
    SELECT n.bn AS number, a.name AS old_name, b.name AS new_name, CAST(changed AS VARCHAR) AS changed_on, CAST(first_day AS VARCHAR) AS old_from, CAST(year(last_day) - year(first_day) + 1 AS BIGINT) AS years
    FROM n JOIN shown a ON a.bn = n.bn AND a.norm = n.name JOIN shown b ON b.bn = n.bn AND b.norm = n.new""")
def rebrands(spark, d):
    """Numbers whose normalised name changes, and the years that only the old name finds."""
    return H.rebrands(view(spark, d, "renamed"), "bn", "name", "start_date", N.norm_name(F.col("name")))


@query("store_differences", "O-239 O-267", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN 'only_a' ELSE 'differs' END AS status FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 991 = 5
        UNION ALL SELECT -o_orderkey, 'only_b' FROM orders WHERE o_orderkey % 983 = 7""")
def store_differences(spark, d):
    """Orders against a copy that lost some, gained some and has some other totals."""
    o = view(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    copy = o.where("o_orderkey % 997 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when((F.col("o_orderkey") % 991 == 5) & (F.col("o_orderkey") % 997 != 0), 1).otherwise(0))
    more = o.where("o_orderkey % 983 = 7").withColumn("o_orderkey", -F.col("o_orderkey"))
    return C.differing_rows(o, copy.unionByName(more), ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


@query("gated_load", "O-201 O-010 O-019", """
    WITH t AS (SELECT *, NOT coalesce(o_totalprice >= 5000, false) AS f1, NOT coalesce(o_orderdate < DATE '2000-12-01', false) AS f2 FROM orders)
    SELECT 'checked' AS measure, count(*) AS n FROM t UNION ALL SELECT 'failed', count(*) FILTER (WHERE f1 OR f2) FROM t UNION ALL SELECT 'failed_total', count(*) FILTER (WHERE f1) FROM t
    UNION ALL SELECT 'failed_date', count(*) FILTER (WHERE f2) FROM t UNION ALL SELECT 'quarantined', count(*) FILTER (WHERE f1 OR f2) FROM t
    UNION ALL SELECT 'loaded', count(*) FILTER (WHERE NOT f1 AND NOT f2 AND o_orderstatus <> 'F') FROM t""")
def gated_load(spark, d):
    """Orders through the gate, then into a store that has the finished ones: conflicts are ignored."""
    rules = {"total": F.col("o_totalprice") >= 5000, "date": F.col("o_orderdate") < F.lit("2000-12-01").cast("date")}
    o = view(spark, d, "orders")
    good, bad, counts = S.gated_write(o, rules, f"{shared_dir(spark)}/gated-{uuid.uuid4().hex}", most=0.5)
    new, _ = S.load_new(good, o.where("o_orderstatus = 'F'"), ["o_orderkey"], F.lit(True))
    told = spark.createDataFrame(list(counts.items()), "measure string, n long")
    return told.unionByName(bad.agg(F.lit("quarantined").alias("measure"), F.count("*").alias("n"))).unionByName(new.agg(F.lit("loaded").alias("measure"), F.count("*").alias("n")))


@query("enriched_suppliers", "O-023", """
    WITH u AS (SELECT l_suppkey AS k, max(l_extendedprice) AS top, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 5 THEN 'returns' END AS note FROM lineitem GROUP BY 1)
    SELECT s_suppkey, coalesce(note, s_name) AS s_name, CAST(coalesce(top, s_acctbal) AS DOUBLE) AS s_acctbal FROM supplier LEFT JOIN u ON k = s_suppkey AND s_suppkey % 3 <> 0""")
def enriched_suppliers(spark, d):
    """Suppliers with values from their lines where there are any; those without lines keep their own."""
    li = view(spark, d, "lineitem").where("l_suppkey % 3 <> 0")
    u = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"), F.when(F.count_if(F.col("l_returnflag") == "R") > 5, "returns").alias("s_name"))
    return S.enrich(view(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), u, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("department_report", "O-027 O-139", """
    WITH g AS (SELECT department, count(*) AS n, sum(amount) AS t FROM {agreements} GROUP BY 1)
    SELECT '| department | agreements | total |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
        string_agg('| ' || department || ' | ' || n || ' | $' || format('{{:,}}', CAST(round(t) AS BIGINT)) || ' |', chr(10) ORDER BY t DESC, department) AS report FROM g""".replace("{{:,}}", "{:,}"))
def department_report(spark, d):
    """A Markdown table of departments with amounts written out: a report of a few rows, as its readers want it."""
    g = view(spark, d, "agreements").groupBy("department").agg(F.count("*").alias("agreements"), F.sum("amount").alias("t"))
    text = S.markdown(g.select("department", "agreements", V.money(F.round("t").cast("long")).alias("total"), "t"), [F.desc("t"), "department"], drop=["t"])
    return spark.createDataFrame([(text,)], "report string")
