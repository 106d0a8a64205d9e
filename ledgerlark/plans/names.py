"""Text, code, number and date rules over the standard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.functions import values as V
from ledgerlark.sources import readers as R

from .registry import query
from .views import view

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '\s+[│|]\s+.*$', ''), '\s+/\s+.*$', ''), '\s*[│|].*$', ''))),
    '\s+(TRADE\s+NAME\s+OF|O\s*/\s*A|D\s*/\s*B\s*/\s*A|DBA|DOING\s+BUSINESS\s+AS|OPERATING\s+AS|TRADING\s+AS|T\s*/\s*A|ASSUMED\s+NAME|AKA|A\.K\.A\.|FORMERLY|F\s*/\s*K\s*/\s*A)\b.*$',
        ''),
    '\(THE\)\s*$', ''), '^THE\s+', ''), '[,\s]+\.\s*$', ''), '[.,;:''"()\-/\\#&!@`]+', ' ', 'g'), '\s{2,}', ' ', 'g'))"""
_PLAIN = r"""trim(regexp_replace(regexp_replace(upper(trim(name)), '[.,;:''"()\-/\\#&!@]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_TRIGRAMS = r"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def trigram_sql(x: str) -> str:
    return _TRIGRAMS.replace("{x}", x)


@query("norm_name", "O-116", f"SELECT id, {_NORM} AS norm FROM {{dirty_names}}")
def norm_name(spark, d):
    return view(spark, d, "dirty_names").select("id", N.norm_name(F.col("name")).alias("norm"))


_FILLER = ", ".join(f"'{w}'" for w in N.FILLER_WORDS)


@query("strict_name", "O-117", f"SELECT id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(replace(upper(name), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ({_FILLER})), ' ') AS strict FROM {{dirty_names}}")
def strict_name(spark, d):
    return view(spark, d, "dirty_names").select("id", N.strict_name(F.col("name")).alias("strict"))


def _deep_sql() -> str:
    x = _PLAIN
    for short, full in N.ABBREVIATIONS.items():
        x = rf"regexp_replace({x}, '\b{short}\b', '{full}', 'g')"
    for s in N.LEGAL_SUFFIXES:
        x = rf"trim(regexp_replace({x}, '\b{s}\b', '', 'g'))"
    return rf"SELECT id, {_PLAIN} AS plain, array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')), ' ') AS deep FROM {{dirty_names}}"


@query("deep_name", "O-118 O-119", _deep_sql())
def deep_name(spark, d):
    return view(spark, d, "dirty_names").select("id", N.plain_name(F.col("name")).alias("plain"), N.deep_name(F.col("name")).alias("deep"))


@query("person_names", "O-120 O-121", r"""
    SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(trim(concat(c_name, ' ', '  de la ' || c_mktsegment))), '[^A-Z0-9 ]', '', 'g'), '\s+',
        ' ', 'g')) AS person, upper(regexp_replace(trim(concat(c_name, ' ', '  de la ' || c_mktsegment)), '\s+', ' ', 'g')) AS display,
        trim(regexp_replace(upper(trim(c_name)), '[^A-Z0-9]+', ' ', 'g')) AS vendor FROM customer""")
def person_names(spark, d):
    c, last = view(spark, d, "customer"), F.concat(F.lit("  de la "), F.col("c_mktsegment"))
    return c.select("c_custkey", N.person_name(F.col("c_name"), last).alias("person"), N.person_display(F.col("c_name"), last).alias("display"), N.vendor_key(F.col("c_name")).alias("vendor"))


@query("bn_roots", "O-125 O-030", r"""
    SELECT id, CASE WHEN length(g) >= 9 AND NOT regexp_matches(left(g, 9), '^[0-9]0{8}$') AND NOT regexp_matches(g, '^0{3}') THEN left(g,
        9) END AS root, CASE WHEN g <> '' THEN 'BN:' || left(g, 9) ELSE upper(trim(name)) || '|' || upper(province) END AS recipient_key
        FROM (SELECT *, regexp_replace(bn, '[^0-9]', '', 'g') AS g FROM {dirty_names}) x""")
def bn_roots(spark, d):
    return view(spark, d, "dirty_names").select("id", N.bn_root(F.col("bn")).alias("root"), N.recipient_key(F.col("bn"), F.col("name"), F.col("province")).alias("recipient_key"))


def _defect_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(bn, '{p}') THEN '{n}'" for n, p in N.BN_DEFECTS)
    return f"SELECT id, CASE WHEN regexp_matches(bn, '^0{{9}}') OR regexp_matches(bn, '^[0-9]{{9}}RR[0-9]{{4}}$') THEN NULL {cases} ELSE '14_other' END AS defect FROM dn"


@query("bn_defects", "O-126 O-237", "WITH dn AS (SELECT * FROM {dirty_names}) " + _defect_sql())
def bn_defects(spark, d):
    return view(spark, d, "dirty_names").select("id", N.bn_defect(F.col("bn")).alias("defect"))


_STOP = ", ".join(f"'{w}'" for w in N.CATEGORY_STOPWORDS)
_CATEGORY = f"array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))), ' ')"


@query("category_keys", "O-123 O-124", f"""
    SELECT DISTINCT t, CASE WHEN {_CATEGORY} <> '' THEN {_CATEGORY} ELSE lower(trim(regexp_replace(t, '[^A-Za-z0-9]+', ' ',
        'g'))) END AS category_key, regexp_replace(t, '[^ -~]', '', 'g') AS printable
        FROM (SELECT concat('Grants for ', p_name, ' and ', p_type, ' (é) services') AS t FROM part UNION ALL SELECT 'The fund of' FROM part) x""")
def category_keys(spark, d):
    p = view(spark, d, "part")
    t = p.select(F.concat(F.lit("Grants for "), "p_name", F.lit(" and "), "p_type", F.lit(" (é) services")).alias("t")).union(p.select(F.lit("The fund of"))).distinct()
    return t.select("t", N.category_key(F.col("t")).alias("category_key"), N.printable(F.col("t")).alias("printable"))


@query("alternate_names", "O-127 O-128 O-258", r"""
    SELECT id, array_to_string(CASE WHEN regexp_matches(name, '(?i)trade\s+name\s+of') THEN list_filter(list_transform(regexp_split_to_array(name,
        '(?i)\s+trade\s+name\s+of\s+'), lambda p: trim(p)), lambda p: length(p) > 2) WHEN regexp_matches(name,
        '(?i)\s+O/A\s+') THEN list_filter(list_transform(regexp_split_to_array(name, '(?i)\s+O/A\s+'), lambda p: trim(p)), lambda p: length(p) > 2)
        WHEN contains(name, '|') THEN list_filter(list_transform(string_split(name, '|'), lambda p: trim(p)), lambda p: length(p) > 2)
            WHEN regexp_matches(name, ',\s*\.\s*$') THEN [trim(regexp_replace(name, ',\s*\.\s*$', ''))] ELSE [name] END, '~') AS names
            FROM {dirty_names}""")
def alternate_names(spark, d):
    return view(spark, d, "dirty_names").select("id", F.array_join(N.alternate_names(F.col("name")), "~").alias("names"))


@query("token_overlaps", "O-129 O-130 O-131", """
    WITH t AS (SELECT p_partkey AS id, p_name, list_distinct(list_filter(string_split(upper(p_name), ' '), lambda w: length(w) > 1)) AS q
        FROM part), p AS (SELECT a.id, b.id AS other, a.p_name AS an, b.p_name AS bn, a.q AS aq, list_transform(b.q, lambda w: w || CASE
        WHEN b.id % 2 = 0 THEN 'S' ELSE '' END) AS bq FROM t a JOIN t b ON b.id = a.id + 1)
    SELECT id, other, round(len(list_filter(aq, lambda x: len(list_filter(bq, lambda y: y = x OR y = x || 'S' OR x = y || 'S' OR (starts_with(y, x)
        AND length(x) >= 5) OR (starts_with(x, y) AND length(y) >= 5))) > 0)) / CAST(len(aq) AS DOUBLE), 6) AS overlap,
           round(len(list_intersect(list_distinct(string_split(an, ' ')), list_distinct(string_split(bn,
               ' ')))) / CAST(len(list_distinct(string_split(an || ' ' || bn, ' '))) AS DOUBLE), 6) AS jaccard FROM p""")
def token_overlaps(spark, d):
    t = view(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", N.core_tokens(F.col("p_name")).alias("q"))
    b = t.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("p_name").alias("bn"), F.transform("q", lambda w: F.concat(w, F.when(F.col("id") % 2 == 0, "S").otherwise(""))).alias("bq"))
    return t.join(b, "id").select("id", "other", F.round(N.token_overlap(F.col("q"), F.col("bq")), 6).alias("overlap"), F.round(N.token_jaccard(F.col("p_name"), F.col("bn")), 6).alias("jaccard"))


# Parameters of the query: all words of the first list, any of the second, none of the third.
ALL_OF, ANY_OF, NONE_OF = ["the"], ["that", "and"], ["card"]


@query("full_text_match", "O-136", f"""
    SELECT count(*) AS documents, round(avg(len(list_filter(w, lambda x: list_contains({ANY_OF}, x))) / CAST(len(w) AS DOUBLE)), 6) AS rank, source
        FROM (SELECT source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) x
        WHERE list_has_all(w, {ALL_OF}) AND list_has_any(w, {ANY_OF}) AND NOT list_has_any(w, {NONE_OF}) GROUP BY source""")
def full_text_match(spark, d):
    w = view(spark, d, "documents").select("source", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("w"))
    return w.where(N.text_match(F.col("w"), ALL_OF, ANY_OF, NONE_OF)).groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(N.text_rank(F.col("w"), ANY_OF)), 6).alias("rank"))


# Names of charities and public bodies in turn over the customers and suppliers.
_KINDS = ["Parish of St ", "Hospital Foundation ", "United Way of ", "Province of ", "University ", "Employees Charity Trust ", "Health Centre ", "Ministry of ", "Roman Catholic ", "Corp "]
_NAMED = f"SELECT c_custkey AS id, {_KINDS}[c_custkey % 10 + 1] || c_name AS name_a, {_KINDS}[c_custkey // 10 % 10 + 1] || n_name AS name_b FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query("label_heuristics", "O-137 O-138", f"""
    WITH x AS (SELECT id, upper(name_a) AS a, upper(name_b) AS b, upper(name_a || ' | ' || name_b) AS t FROM ({_NAMED}) n),
    y AS (SELECT id, CASE WHEN regexp_matches(t,
        '(ROMAN CATHOLIC|SEVENTH-DAY ADVENTIST|ANGLICAN|DIOCESE|PARISH|BAPTIST|PRESBYTERIAN)') THEN 'likely_normal_denominational_network'
        WHEN contains(t, 'FOUNDATION') AND regexp_matches(t, 'HOSPITAL|HEALTH') THEN 'likely_normal_foundation_operator'
            WHEN regexp_matches(t, 'UNITED WAY|YMCA|YWCA|FEDERATION|FEDERATED|COMMUNITY FOUNDATION') THEN 'likely_normal_federated_network' ELSE 'review' END AS loop_label,
        CASE WHEN (contains(a, 'UNIVERSITY') AND b LIKE '%EMPLOYEES%CHARITY%TRUST%') OR (contains(b, 'UNIVERSITY')
            AND a LIKE '%EMPLOYEES%CHARITY%TRUST%') THEN 'likely_normal_university_affiliate' WHEN (contains(a, 'FOUNDATION') AND regexp_matches(b,
            'HOSPITAL|HEALTH')) OR (contains(b, 'FOUNDATION') AND regexp_matches(a, 'HOSPITAL|HEALTH')) THEN 'likely_normal_foundation_operator'
            WHEN contains(a, 'SEVENTH-DAY ADVENTIST') AND contains(b, 'SEVENTH-DAY ADVENTIST') OR contains(a, 'ROMAN CATHOLIC') AND contains(b,
                'ROMAN CATHOLIC') THEN 'likely_normal_denominational_network' ELSE 'review' END AS pair_label,
        len(list_filter(['government', 'gouvernement', 'province of', 'province de', 'ministry', 'ministère', 'ministre', 'batch report',
            'rapport en lots'], lambda g: contains(lower(a), g))) > 0 AS government FROM x)
    SELECT loop_label, pair_label, government, count(*) AS n, min(id) AS first_id FROM y GROUP BY 1, 2, 3""")
def label_heuristics(spark, d):
    kind = lambda k: F.element_at(F.array(*map(F.lit, _KINDS)), (k % 10 + 1).cast("int"))
    c = view(spark, d, "customer").join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    n = c.select(key.alias("id"), F.concat(kind(key), "c_name").alias("a"), F.concat(kind(F.floor(key / 10)), "n_name").alias("b"))
    labels = [N.loop_label(F.concat_ws(" | ", "a", "b")).alias("loop_label"), N.pair_label(F.col("a"), F.col("b")).alias("pair_label"), N.is_government(F.col("a")).alias("government")]
    return n.groupBy(*labels).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("case_ids", "O-140 O-122 O-139", """
    SELECT id, 'ab:' || md5(upper(name)) AS case_id, coalesce(CASE WHEN regexp_matches(bn, '^[1-9][0-9]{8}') THEN 'bn:' || left(bn, 9) END,
        'geo:' || lower(trim(name)) || '|' || province) AS entity_key FROM {dirty_names}""")
def case_ids(spark, d):
    n = view(spark, d, "dirty_names")
    bn = F.when(F.col("bn").rlike("^[1-9][0-9]{8}"), F.concat(F.lit("bn:"), F.left("bn", F.lit(9))))
    return n.select("id", F.concat(F.lit("ab:"), F.md5(F.upper("name"))).alias("case_id"), F.coalesce(bn, F.concat(F.lit("geo:"), F.lower(F.trim("name")), F.lit("|"), "province")).alias("entity_key"))


@query("parsed_values", "O-252 O-253 O-254", """
    SELECT * FROM (VALUES (1, 3138.0, 3138, '1979-06-18', 'ON', TRUE), (2, 1000.0, 1000, '2015-06-22', NULL, FALSE), (3, NULL, NULL, NULL, NULL,
        NULL), (4, 3.14, 3, '2020-02-29', 'BC', TRUE), (5, -12.5, -12, NULL, NULL, NULL)) t(id, amount, whole, day, code, flag)""".replace("SELECT *", "SELECT CAST(id AS BIGINT) AS id, CAST(amount AS DOUBLE) AS amount, CAST(whole AS BIGINT) AS whole, day, code, flag"))
def parsed_values(spark, d):
    rows = spark.createDataFrame([(1, "$3,138.00", "3138", "1979/06/18", " on ", "Y"), (2, "$ 1,000", "1,000", "6/22/2015 12:00:00 AM", "ONT", "False"), (3, "abc", "abc", "0001-01-01", "12", "?"), (4, "3.14", "3.14", "43890", "bc", "X"), (5, "-12.5", "-12.9", "3000-01-01", "", "")], "id long, a string, w string, t string, c string, f string")
    return rows.select("id", V.parse_decimal(F.col("a")).alias("amount"), V.parse_int(F.col("w")).alias("whole"), V.parse_date(F.col("t")).cast("string").alias("day"), V.two_letter_code(F.col("c")).alias("code"), V.parse_bool(F.col("f")).alias("flag"))


@query("fiscal_calendar", "O-229 O-227 O-251 O-250", """
    SELECT CASE WHEN m >= 4 THEN concat(CAST(y AS VARCHAR), '-', CAST(y + 1 AS VARCHAR)) ELSE concat(CAST(y - 1 AS VARCHAR), '-',
        CAST(y AS VARCHAR)) END AS fiscal_year, CAST(CASE WHEN m >= 4 THEN floor((m - 4) / 3) + 1 ELSE 4 END AS BIGINT) AS quarter,
        count(*) AS orders, CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(max(date_diff('day', dt,
        DATE '2001-08-01')) AS BIGINT) AS oldest_days
    FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_totalprice AS p, CAST(o_orderdate AS DATE) AS dt FROM orders) x GROUP BY 1, 2""")
def fiscal_calendar(spark, d):
    t = F.col("o_orderdate")
    return view(spark, d, "orders").groupBy(V.fiscal_year(t).alias("fiscal_year"), V.fiscal_quarter(t).alias("quarter")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max(F.datediff(F.lit("2001-08-01").cast("date"), t.cast("date"))).alias("oldest_days"))


@query("page_fields", "O-013", r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html,
        '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''),
        '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?is)<li\b[^>]*>')) AS items FROM pages""")
def page_fields(spark, d):
    h = F.col("html")
    return view(spark, d, "pages").select("page_id", R.strip_markup(R.tag_text(h, "title")).alias("title"), F.size(F.regexp_extract_all(h, F.lit(r"(?is)(<li\b[^>]*>)"), 1)).cast("bigint").alias("items"))


# Fixed values of this query: terms that stand for adverse media in the standard texts.
TERMS = ("trash", "the", "that", "und", "pour")


@query("media_score", "O-209", """
    WITH t AS (SELECT doc_id, source, text, list_filter(['trash', 'the', 'that', 'und', 'pour'], lambda t: contains(lower(text), t)) AS m
        FROM documents WHERE NOT contains(lower(left(text, 80)), 'license')),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, trim(regexp_replace(lower(left(text, 60)), '\\s+', ' ', 'g')) ORDER BY doc_id) AS rn FROM t WHERE len(m) > 0)
    SELECT doc_id, array_to_string(m, ',') AS terms, CAST(least(100, 10 + CASE WHEN contains(lower(text), source) THEN 20
        ELSE 0 END + least(len(m) * 14, 50) + CASE WHEN source = 'src1' THEN 8 ELSE 0 END) AS BIGINT) AS severity FROM k WHERE rn = 1""")
def media_score(spark, d):
    from ledgerlark.operators.media import score_articles

    docs = view(spark, d, "documents")
    articles = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("company"), F.left("text", F.lit(60)).alias("headline"), F.col("text").alias("body"), F.col("source").alias("link"), F.when(F.col("source") == "src1", "newsapi").otherwise("rss").alias("provider"), F.lit(None).cast("date").alias("day")).where(~F.lower(F.left("text", F.lit(80))).contains("license"))
    return score_articles(articles, TERMS, (), as_of="2024-01-01").select(F.col("id").alias("doc_id"), "terms", "severity")
