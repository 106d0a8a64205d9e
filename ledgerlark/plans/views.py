"""Logical inputs over the standard tables. Each is one SELECT that Spark and the oracle read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.sources.store import TASK_ROWS, dealt

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LINE_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey"

VIEWS = {
    # one row per agreement and amendment; values are cumulative, a seventh of the recipients has no number
    "agreements": f"""
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
            CAST(CAST(l_shipdate AS DATE) AS STRING)) AS line_id,
               l_orderkey AS ref_number, CAST(seq - 1 AS STRING) AS amendment_number, seq > 1 AS is_amendment,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY seq) AS DECIMAL(18,2)) AS agreement_value,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, c_custkey, c_name AS recipient, CASE WHEN c_custkey % 7 = 0 THEN NULL
                   ELSE lpad(CAST(c_custkey AS STRING), 9, '1') END AS bn,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'MACHINERY' THEN 'N' WHEN 'AUTOMOBILE' THEN 'F' WHEN 'FURNITURE' THEN 'P' ELSE 'G' END AS recipient_type,
               cn.n_name AS province, sn.n_name AS department, p_type AS program, s_name AS vendor, l_returnflag = 'R' AS sole_source,
               CAST(o_orderdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) AS amendment_date
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS seq FROM {{lineitem}}) l
        JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} cn ON cn.n_nationkey = c_nationkey
        JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} sn ON sn.n_nationkey = s_nationkey JOIN {{part}} ON p_partkey = l_partkey""",
    # one row per contract line with its vendor and ministry
    "contracts": """
        SELECT l_orderkey AS contract_number, s_suppkey, s_name AS vendor, n_name AS ministry, p_type AS services, l_returnflag = 'R' AS sole_source,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               CAST(l_shipdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS award_date, CASE WHEN l_linestatus = 'O' THEN 'z'
                   ELSE 'a' END AS situation, l_linenumber AS line, l_partkey AS part_id
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey
            JOIN {part} ON p_partkey = l_partkey""",
    # gifts from the customer's nation to the supplier's
    "gifts": """
        SELECT c_nationkey AS src, s_nationkey AS dst, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, year(o_orderdate) AS year
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey""",
    # gifts from customers to suppliers in one space of ids; an edge is made of gifts of 97,000 and more
    "party_edges": """
        SELECT o_custkey AS src, l_suppkey AS dst, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_amt,
            min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_extendedprice >= 97000 AND o_custkey <> l_suppkey GROUP BY o_custkey, l_suppkey""",
    "party_flows": """
        SELECT o_custkey AS src, l_suppkey AS dst, year(o_orderdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_extendedprice >= 97000 AND o_custkey <> l_suppkey GROUP BY o_custkey, l_suppkey, year(o_orderdate)""",
    # the two largest edges of each node and year (a parameter of these queries, as is the three of the next view)
    "year_edges": """
        SELECT src, dst, total_amt, year AS min_year, year AS max_year FROM (
            SELECT *, row_number() OVER (PARTITION BY src, year ORDER BY total_amt DESC, dst) AS rn FROM (
                SELECT src, dst, year, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amt FROM {gifts} WHERE src <> dst GROUP BY src, dst, year) a) b
        WHERE rn <= 2""",
    "all_edges": "SELECT src, dst, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amt, min(year) AS min_year, max(year) AS max_year FROM {gifts} WHERE amount >= 5000 AND src <> dst GROUP BY src, dst",
    # the three largest edges of each node over all years
    "top_edges": """
        SELECT src, dst, total_amt, min_year, max_year FROM (
            SELECT *, row_number() OVER (PARTITION BY src ORDER BY total_amt DESC, dst) AS rn FROM (
                SELECT src, dst, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amt, min(year) AS min_year, max(year) AS max_year FROM {gifts}
                    WHERE amount >= 5000 AND src <> dst GROUP BY src, dst) a) b
        WHERE rn <= 3""",
    # a user's purchase of 60 or more hands over to the next user's
    "event_edges": """
        SELECT src, dst, CAST(sum(v) AS DECIMAL(18,2)) AS total_amt FROM (
            SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst,
                CAST(value AS DECIMAL(18,2)) AS v FROM {events} WHERE event_type = 'purchase') p
        WHERE dst IS NOT NULL AND src <> dst AND v >= 60 GROUP BY src, dst""",
    "yearly_flows": "SELECT src, dst, year, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM {gifts} WHERE src <> dst GROUP BY src, dst, year",
    # customers who returned urgent goods of a supplier stand for its directors
    "roles": """
        SELECT s_suppkey AS org, c_custkey AS person, year(o_orderdate) AS year
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey
        WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'""",
    # wide filings: an order's stated total beside sums by return flag, some parts unstated
    "filings": """
        SELECT o_orderkey AS filing, c_custkey AS filer, year(o_orderdate) AS year, CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total, a, b, c,
               CAST(coalesce(a, 0) + coalesce(b, 0) AS DECIMAL(18,2)) AS program_spending, coalesce(c, CAST(0 AS DECIMAL(18,2))) AS compensation
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey LEFT JOIN (
            SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS a,
                CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS b,
                   CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS c FROM {lineitem}
                       GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""",
    # organisations with the name forms that sources show
    "dirty_names": """
        SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN concat('The ', c_name, ', Inc.') WHEN 1 THEN concat(c_name, ' | Société ',
            CAST(c_custkey AS STRING)) WHEN 2 THEN concat(c_name, ' O/A Trade ', CAST(c_custkey % 50 AS STRING))
                   WHEN 3 THEN concat(upper(c_name), ' LTD') WHEN 4 THEN concat('  ', c_name, '  & Sons, .') WHEN 5 THEN concat('Univ of ', c_name,
                       ' Fdn') WHEN 6 THEN concat(c_name, ' trade name of Centre ', CAST(c_custkey % 50 AS STRING)) WHEN 7 THEN concat('Dept. ',
                       c_name, ' (the)') ELSE c_name END AS name,
               CASE c_custkey % 8 WHEN 0 THEN concat(lpad(CAST(c_custkey AS STRING), 9, '1'), 'RR0001') WHEN 1 THEN lpad(CAST(c_custkey AS STRING), 9,
                   '1') WHEN 2 THEN concat(lpad(CAST(c_custkey AS STRING), 9, '1'), 'RC', CAST(c_custkey % 7 AS STRING)) WHEN 3 THEN '000000000RR0001'
                   WHEN 4 THEN concat(lpad(CAST(c_custkey AS STRING), 8, '2'), 'RR0001') WHEN 5 THEN concat('1188 ', CAST(c_custkey AS STRING))
                       WHEN 6 THEN concat(lpad(CAST(c_custkey AS STRING), 9, '1'), 'RR01') ELSE 'N/A' END AS bn,
               n_name AS province, c_mktsegment AS segment
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    # two records of each organisation k, ids 10 k + 1 and 10 k + 2: its own, and one with a variant of its name; where
    # k % 6 = 4 the second has a number of its own as a charity and is another organisation
    "party_names": """
        SELECT k, concat(translate(lpad(CAST(k * 7919 % 1000003 AS STRING), 6, '0'), '0123456789', 'abeghiknrt'), ' ',
            translate(lpad(CAST(k * 104729 % 1000003 AS STRING), 6, '0'), '0123456789', 'clomdpsuvy'), ' ', lower(segment)) AS base,
            translate(lpad(CAST(k * 611953 % 1000003 AS STRING), 6, '0'), '0123456789', 'fjqwxzaeio') AS other, province
        FROM (SELECT c_custkey AS k, c_mktsegment AS segment, n_name AS province FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey) c""",
    "party_entities": """
        SELECT k * 10 + 1 AS id, base AS name, CAST(120000000 + k AS STRING) AS bn, 'cra' AS source, k % 5 + 1 AS links, province FROM {party_names}
        UNION ALL SELECT k * 10 + 2, CASE k % 6 WHEN 0 THEN concat('The ', base, ' (the)') WHEN 1 THEN concat(other, ' trade name of ', base)
                WHEN 2 THEN concat(other, ' O/A ', base) WHEN 3 THEN concat(substr(base, 1, 4), 'w', substr(base, 6)) WHEN 5 THEN concat(other, ' group') ELSE base END,
            CASE k % 6 WHEN 4 THEN CAST(220000000 + k AS STRING) WHEN 5 THEN CAST(120000000 + k AS STRING) END,
            CASE k % 6 WHEN 4 THEN 'cra' ELSE 'fed' END, k % 7, province FROM {party_names}""",
    # a linkage model's predictions, some too low or too sure to be asked about
    "party_predictions": "SELECT k * 10 + 1 AS id_a, k * 10 + 2 AS id_b, CAST(CAST(k * 31 % 100 AS DECIMAL(9,2)) / 100 AS DOUBLE) AS probability FROM {party_names} WHERE k % 4 = 1",
    # source rows that point at an entity
    "party_links": "SELECT o_orderkey AS link_id, o_custkey * 10 + 1 + o_orderkey % 2 AS entity_id, year(o_orderdate) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    # gifts that cite a number and a name: placeholders, malformed and unknown numbers, names that fit and that do not
    "citations": """
        SELECT CASE WHEN k % 7 = 0 THEN '000000000RR0001' WHEN k % 7 = 1 THEN concat(CAST(120000000 + k AS STRING), 'RC2') WHEN k % 7 = 2 THEN concat(CAST(520000000 + k AS STRING), 'RR0001')
                ELSE concat(CAST(120000000 + k AS STRING), 'RR0001') END AS number,
            CASE WHEN k % 7 = 3 THEN other WHEN k % 7 = 4 THEN concat(substr(base, 1, 4), 'w', substr(base, 6)) ELSE concat('The ', base) END AS name, k * 10 AS amount
        FROM {party_names}""",
    # names of source rows to be resolved: exact, after a bar, behind a trade name, by number, with a number that nobody has, unknown
    "party_pending": """
        SELECT k * 10 + j AS id, CASE j WHEN 0 THEN upper(base) WHEN 1 THEN concat(other, ' | ', base) WHEN 2 THEN concat('Old ', other, ' trade name of ', base)
                WHEN 3 THEN other WHEN 4 THEN concat(other, ' x') WHEN 5 THEN concat('The ', base) WHEN 6 THEN '...' ELSE concat(other, ' y') END AS name,
            CASE j WHEN 3 THEN CAST(120000000 + k AS STRING) WHEN 4 THEN CAST(320000000 + k % 100 AS STRING) END AS bn
        FROM (SELECT k, base, other, explode_j AS j FROM {party_names} CROSS JOIN (SELECT 0 AS explode_j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3
            UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) js) x""",
    # payments in whole thousands; returned goods are paid back
    "payments": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS vendor, CAST(floor(l_extendedprice / 1000) * CASE WHEN l_returnflag = 'R' THEN -1000 ELSE 1000 END AS BIGINT) AS amount,
            CAST(l_shipdate AS DATE) AS day FROM {lineitem}""",
    # three names of each ministry, one after the other; the last is still valid
    "ministry_names": """
        SELECT n_nationkey AS ministry_id, concat('Ministry ', n_name, ' ', CAST(v AS STRING)) AS name,
            make_date(CAST(1985 + v * 5 + n_nationkey % 3 AS INT), CAST(1 + n_nationkey % 12 AS INT), 1) AS valid_from,
            CASE WHEN v < 3 THEN make_date(CAST(1990 + v * 5 + n_nationkey % 3 AS INT), CAST(1 + n_nationkey % 12 AS INT), 1) END AS valid_to
        FROM {nation} JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) vs ON v > 0""",
    # a third of the numbered recipients take another name in some year, half of these only write it in another way
    "renamed": """
        SELECT bn, start_date, CASE WHEN c_custkey % 3 = 0 AND year(start_date) >= 1995 + c_custkey % 4 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('The ', recipient, ' (the)')
            ELSE concat('New ', recipient) END ELSE recipient END AS name FROM {agreements} WHERE bn IS NOT NULL""",
    # suppliers as a registry
    "registry": """
        SELECT s_suppkey AS id, s_name AS name, n_name AS province, CASE WHEN s_acctbal < 0 THEN 'DISSOLVED' WHEN s_acctbal < 2000 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
               make_date(CAST(1970 + s_suppkey % 30 AS INT), CAST(1 + s_suppkey % 12 AS INT), CAST(1 + s_suppkey % 28 AS INT)) AS registered
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "recipients": """
        SELECT recipient_key, min(recipient) AS name, min(bn) AS bn, min(recipient_type) AS recipient_type, min(province) AS province,
            count(DISTINCT CASE WHEN NOT is_amendment THEN line_id END) AS grant_count, sum(CASE WHEN is_amendment THEN 1
            ELSE 0 END) AS amendment_count,
               CAST(sum(amount) AS DECIMAL(18,2)) AS total_value, max(amount) AS max_value, CAST(sum(amount) AS DOUBLE) / count(DISTINCT CASE
                   WHEN NOT is_amendment THEN line_id END) AS avg_value, count(DISTINCT department) AS dept_count,
               min(start_date) AS first_grant, max(start_date) AS last_grant, year(max(start_date)) AS last_year, max(CASE
                   WHEN is_amendment THEN amendment_date END) AS last_amendment_date
        FROM (SELECT *, CASE WHEN bn IS NOT NULL THEN concat('BN:', bn) ELSE concat_ws('|', upper(recipient), recipient_type,
            upper(province)) END AS recipient_key FROM {agreements}) r GROUP BY recipient_key""",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A standard table or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    text = VIEWS[name]
    tables = {n: view(spark, folder, n) for n in set(re.findall(r"\{([a-z]\w+)\}", text))}
    if name in WIDE:
        tables |= _dealt(tables)
    return spark.sql(text, **tables)


# Views that carry wide rows of each line through several joins, and the keys of these joins.
WIDE = ("agreements", "contracts")
_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def _dealt(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables dealt by their keys over as many tasks as lines need; small ones, which are sent whole, stay as they are."""
    lines = tables["lineitem"].count()
    return {n: dealt(t, _KEYS[n], count=lines) for n, t in tables.items() if n in _KEYS and (n in ("lineitem", "orders") or t.count() > TASK_ROWS)}


def oracle_view(name: str) -> str:
    """The view as a subquery in the oracle's dialect."""
    if name in TABLES:
        return name
    text = re.sub(r"\{([a-z]\w+)\}", lambda m: oracle_view(m[1]), VIEWS[name]).replace("AS STRING)", "AS VARCHAR)")
    return f"({text})"


def oracle(text: str) -> str:
    """Oracle SQL with each {view} written out once as a common table expression."""
    names = list(dict.fromkeys(re.findall(r"\{([a-z]\w+)\}", text)))
    if not names:
        return text
    needed: list[str] = []

    def need(n: str) -> None:
        for m in re.findall(r"\{([a-z]\w+)\}", VIEWS.get(n, "")):
            if m not in TABLES:
                need(m)
        if n not in needed and n not in TABLES:
            needed.append(n)

    for n in names:
        need(n)
    plain = lambda t: re.sub(r"\{([a-z]\w+)\}", r"\1", t)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})".replace("AS STRING)", "AS VARCHAR)") for n in needed)
    body = plain(text).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
