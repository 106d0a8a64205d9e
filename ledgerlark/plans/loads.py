"""Sources and sinks: standard tables written in the files' formats and read back through the readers."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import values as V
from ledgerlark.operators import compare as C
from ledgerlark.sources import datasets as D
from ledgerlark.sources import readers as R
from ledgerlark.sources import sinks as S
from ledgerlark.sources.store import shared_dir

from .registry import query
from .views import view


def _path(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_TEXT = T.StringType()


@query("csv_load", "O-007 O-008 O-009 O-010 O-027 O-266", """
    SELECT s_suppkey AS id, s_name || ' "x", y' AS legal_name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, '2001-02-03' AS day FROM supplier""")
def csv_load(spark, d):
    path = _path(spark, "csv")
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("ID"), F.concat("s_name", F.lit(' "x", y')).alias("Legal Name"), F.concat(F.lit("$"), F.format_number(F.col("s_acctbal").cast("decimal(18,2)"), 2)).alias("Balance"), F.lit("2/3/2001 12:00:00 AM").alias("Day"))
    S.export(s, path, "csv")
    raw = R.csv(spark, path, T.StructType([T.StructField(c, _TEXT) for c in s.columns]), max_bad=0)
    return R.crosswalk(raw, {"id": ("id", V.parse_int), "legal_name": ("legal name", V.blank_to_null), "balance": ("balance", V.parse_decimal), "day": ("day", V.parse_date)})


@query("json_load", "O-004 O-005 O-266", """
    SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, o_orderpriority AS program,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS payment_date FROM orders""")
def json_load(spark, d):
    path = _path(spark, "json")
    o = view(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("$numberLong"))).alias("id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.col("o_orderpriority").alias("program"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("payment_date"))
    S.export(o, path, "json")
    kept = ["id", "amount", "program", "payment_date"]
    raw = R.json_lines(spark, path, T.StructType([T.StructField(c, _TEXT) for c in kept])).withColumn("id", R.extended_scalar(F.col("id")))
    return R.crosswalk(raw, {c: (c, D.CLEANERS[D.columns_of("provincial_grants")[c]]) for c in kept})


@query("parquet_load", "O-015 O-021 O-022 O-026", "SELECT n_nationkey AS k, n_name AS name, copies FROM nation, (SELECT unnest([1, 2]) AS copies) c".replace("n_nationkey AS k", "CAST(n_nationkey AS BIGINT) AS k").replace("copies FROM", "CAST(copies AS BIGINT) AS copies FROM", 1))
def parquet_load(spark, d):
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    paths = [_path(spark, f"parquet{i}") for i in (1, 2)]
    for i, p in enumerate(paths, 1):
        one = n.withColumn("copies", F.lit(i))
        S.rebuild(one.unionByName(one), p)
    return R.deduplicated(spark, paths, ["k"])


@query("api_pages", "O-002 O-003 O-259", "SELECT CAST(o AS BIGINT) AS \"offset\", '{\"from\": ' || CAST(o AS VARCHAR) || ', \"n\": 10000}' AS body FROM (SELECT unnest(range(0, (SELECT count(*) FROM lineitem), 10000)) AS o) x WHERE o <> 10000")
def api_pages(spark, d):
    total = view(spark, d, "lineitem").count()
    pages = R.offsets_to_fetch(spark, total, 10_000, spark.createDataFrame([(10_000,)], "offset long"))
    return R.fetch_pages(pages, lambda offset, limit: f'{{"from": {offset}, "n": {limit}}}')


@query("zip_members", "O-011", "SELECT r_name || '.csv' AS member, length('id,name' || chr(10) || CAST(r_regionkey AS VARCHAR) || ',' || r_name || chr(10)) AS size FROM region")
def zip_members(spark, d):
    def packed(batches):
        import pandas as pd

        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                for k, name in zip(batch.r_regionkey, batch.r_name):
                    z.writestr(f"{name}.csv", f"id,name\n{k},{name}\n")
                z.writestr("readme.txt", "x")
            yield pd.DataFrame({"path": ["r.zip"], "content": [buffer.getvalue()]})

    files = view(spark, d, "region").mapInPandas(packed, "path string, content binary")
    return R.members(files).select("member", "size")


@query("source_manifest", "O-016", """
    SELECT t AS name, n AS row_count, n > 0 AS there FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*)
        FROM region) x""")
def source_manifest(spark, d):
    m = R.sources_registry(spark, [(n, f"{d}/{n}.parquet", "parquet", True) for n in ("nation", "region")])
    counts = R.row_counts({n: view(spark, d, n) for n in ("nation", "region")}).withColumnRenamed("table_name", "name")
    return m.join(counts, "name", "left").select("name", "row_count", (F.col("row_count") > 0).alias("there"))


@query("xlsx_load", "O-006", "SELECT r_name || '.xlsx' AS book, CAST(3 AS BIGINT) AS row, CAST(r_regionkey AS VARCHAR) AS id, r_name AS legal_name FROM region")
def xlsx_load(spark, d):
    """Workbooks with their header on the second row."""
    sheet = "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>{}</sheetData></worksheet>"
    row = lambda n, *cells: f"<row r='{n}'>" + "".join(f"<c r='{c}{n}' t='inlineStr'><is><t>{v}</t></is></c>" for c, v in zip("AB", cells)) + "</row>"

    def book(batches):
        import pandas as pd

        for batch in batches:
            for k, name in zip(batch.r_regionkey, batch.r_name):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("xl/worksheets/sheet1.xml", sheet.format(row(1, "a title") + row(2, "ID", "Legal Name") + row(3, k, name)))
                yield pd.DataFrame({"path": [f"{name}.xlsx"], "content": [buffer.getvalue()]})

    got = R.xlsx_rows(view(spark, d, "region").mapInPandas(book, "path string, content binary"))
    return got.select(F.col("path").alias("book"), "row", F.col("cells")["id"].alias("id"), F.col("cells")["legal_name"].alias("legal_name"))


@query("registry_xml", "O-012", """
    SELECT CAST(s_suppkey AS VARCHAR) AS corporation_id, s_name AS name, CASE WHEN s_acctbal < 0 THEN '11' ELSE '1' END AS status_code,
        '2001-02-03' AS last_activity, 'b' AS last_activity_code FROM supplier""")
def registry_xml(spark, d):
    """Corporations of an XML registry: the current name and status, the last activity."""
    path = _path(spark, "xml")
    code = F.when(F.col("s_acctbal") < 0, "11").otherwise("1")
    form = "<corporation corporationId='%d'><names current='false'>Old</names><names current='true'>%s</names><statuses code='9' current='false'>x</statuses><statuses code='%s' current='true'>y</statuses><activities date='2001-02-03' code='b'/><activities date='1999-05-06' code='a'/></corporation>"
    s = view(spark, d, "supplier").select(F.format_string(form, "s_suppkey", "s_name", code).alias("value"))

    def rooted(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ["<corporations>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</corporations>"]})

    s.mapInPandas(rooted, "value string").write.text(path)
    return R.registry_rows(R.xml_rows(spark, path, "corporation", R.REGISTRY))


@query("news_items", "O-014", "SELECT page_id AS id, 'Notice ' || CAST(page_id AS VARCHAR) AS title, url AS link, CAST(length(html) AS BIGINT) AS size FROM pages")
def news_items(spark, d):
    """Items of a JSON news service; a call that fails gives no item and not an error."""
    bodies = view(spark, d, "pages").select("page_id", F.when(F.col("page_id").isNotNull(), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Notice "), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("link"), F.length("html").alias("size"))).alias("articles")))).alias("body"))
    failed = bodies.where("page_id % 10 = 0").select("page_id", F.lit("timed out").alias("body"))
    return R.json_items(bodies.unionByName(failed), "body", "articles", "title string, link string, size long").select(F.col("page_id").alias("id"), "title", "link", "size")


@query("table_catalogue", "O-017", """
    SELECT t AS table_name, t <> 'absent' AS there, n AS columns FROM (SELECT 'nation' AS t, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'region', 2
        UNION ALL SELECT 'absent', NULL) x""")
def table_catalogue(spark, d):
    """Which tables there are, and how many columns they have, from the catalogue."""
    for n in ("nation", "region"):
        view(spark, d, n).createOrReplaceTempView(n)
    return R.catalogue(spark, ["nation", "region", "absent"])


@query("typed_audit", "O-268", """
    SELECT 'balance' AS field, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS differing, count(*) AS checked FROM supplier
        UNION ALL SELECT 'day', 0, count(*) FROM supplier UNION ALL SELECT 'name', count(*) FILTER (WHERE s_suppkey % 5 = 0), count(*) FROM supplier""")
def typed_audit(spark, d):
    """Fields of a source as text against the stored values, equal by type: decimals to 1e-6, dates with any separator."""
    s = view(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("balance"), F.lit("2001-02-03").cast("date").alias("day"), F.col("s_name").alias("name"))
    k = F.col("s_suppkey")
    text = s.select(k, F.when(k % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")).cast("string").alias("balance"), F.lit("2001/02/03").alias("day"), F.when(k % 5 == 0, F.upper("name")).otherwise(F.concat(F.lit(" "), "name")).alias("name"))
    return C.typed_audit(text, s, ["s_suppkey"], {"balance": "decimal", "day": "date", "name": "text"})


@query("reload_levels", "O-267", """
    WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS done, CAST(o_totalprice AS DECIMAL(28,4)) AS t FROM orders), b AS (SELECT * FROM s WHERE o_orderkey % 100 <> 1),
    m AS (SELECT 'keys' AS measure, (SELECT count(DISTINCT o_orderkey) FROM s) AS x, (SELECT count(DISTINCT o_orderkey) FROM b) AS y
        UNION ALL SELECT 'rows', (SELECT count(*) FROM s), (SELECT count(*) FROM b) UNION ALL SELECT 'filled:t', (SELECT count(t)
        FROM s), (SELECT count(t) FROM b) UNION ALL SELECT 'sum:t', (SELECT sum(t) FROM s), (SELECT sum(t) FROM b)
        UNION ALL SELECT 'true:done', (SELECT count(*) FROM s WHERE done), (SELECT count(*) FROM b WHERE done)
        UNION ALL SELECT 'unmapped', 0, (SELECT count(*) FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)))
    SELECT measure, CAST(x AS DOUBLE) AS source_value, CAST(y AS DOUBLE) AS store_value, CASE WHEN measure = 'sum:t' THEN abs(x - y) <= greatest(1,
        abs(x) * 1e-4) ELSE abs(x - y) <= greatest(5, abs(x) * 1e-4) END AS ok FROM m""")
def reload_levels(spark, d):
    """All levels of a reload check: keys, rows, filled values, sums, flags, and keys that the store lacks."""
    s = view(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").cast("decimal(28,4)").alias("t"))
    store = s.where("o_orderkey % 100 <> 1")
    extra = C.unmapped(s, store, ["o_orderkey"])
    return C.reload_check(C.profile(s, ["o_orderkey"], ["t"], ["done"]).unionByName(extra.withColumn("value", F.lit(0.0))), C.profile(store, ["o_orderkey"], ["t"], ["done"]).unionByName(extra))


_KINDS = {"text": "' x '", "money": "'$1,234.50'", "whole": "'42'", "date": "'2001/02/03'", "flag": "'Y'", "code": "'on'", "list": "'a|b'"}
_READ = {"text": "x", "money": "1234.50", "whole": "42", "date": "2001-02-03", "flag": "true", "code": "ON", "list": '["a","b"]'}


@query("dataset_importers", "O-266", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{c}', '{_READ[kind]}', (SELECT count(*) FROM nation))" for name in D.DATASETS for c, kind in D.columns_of(name).items()) + ") AS t(dataset, field, value, rows)")
def dataset_importers(spark, d):
    """Every dataset's importer over rows of text: what each column of a row becomes."""
    found = None
    for name in D.DATASETS:
        columns = D.columns_of(name)
        text = view(spark, d, "nation").select(*(F.expr(_KINDS[kind]).alias(c) for c, kind in columns.items()))
        rows = D.typed(text, name)
        shown = F.array(*(F.struct(F.lit(c).alias("field"), (F.to_json(c) if kind == "list" else F.col(c).cast("string")).alias("value")) for c, kind in columns.items()))
        one = rows.select(F.lit(name).alias("dataset"), F.explode(shown).alias("x")).groupBy("dataset", "x.field", "x.value").agg(F.count("*").alias("rows"))
        found = one if found is None else found.unionByName(one)
    return found


@query("vendor_tactics", "O-199", """
    WITH v AS (SELECT vendor, count(*) AS n, CAST(max(amount) AS DOUBLE) / CAST(arg_min(amount, (start_date, contract_number, line,
        part_id)) AS DOUBLE) AS growth, count(*) FILTER (WHERE amount >= 23750 AND amount < 25000) AS split FROM {contracts} GROUP BY 1)
    SELECT vendor, CAST(CASE WHEN growth > 3 THEN 40 ELSE 0 END + CASE WHEN split >= 2 THEN 30 ELSE 0 END + CASE WHEN n >= 3 AND growth > 2 THEN 30
        ELSE 0 END AS BIGINT) AS score FROM v""")
def vendor_tactics(spark, d):
    c = view(spark, d, "contracts")
    first = F.min_by("amount", F.struct("start_date", "contract_number", "line", "part_id"))
    v = c.groupBy("vendor").agg(F.count("*").alias("n"), F.max("amount").alias("most"), first.alias("first"), F.count_if((F.col("amount") >= 23750) & (F.col("amount") < 25000)).alias("split"))
    growth = V.ratio(F.col("most"), F.col("first"))
    return v.select("vendor", V.total([V.flag(growth > 3, 40), V.flag(F.col("split") >= 2, 30), V.flag((F.col("n") >= 3) & (growth > 2), 30)]).alias("score"))


@query("overlap_and_gaps", "O-207", """
    WITH p AS (SELECT program, department, CAST(sum(amount) AS DOUBLE) AS spent, count(DISTINCT recipient) AS recipients FROM {agreements}
        GROUP BY 1, 2), o AS (SELECT program, count(*) AS departments, sum(spent) AS spent, max(spent) / sum(spent) AS lead FROM p GROUP BY 1)
    SELECT program, departments, round(spent, 2) AS spent, CASE WHEN departments >= 5 AND lead < 0.5 THEN 'overlap' WHEN departments = 1 THEN 'gap'
        ELSE 'shared' END AS kind FROM o""")
def overlap_and_gaps(spark, d):
    p = view(spark, d, "agreements").groupBy("program", "department").agg(F.sum("amount").alias("spent"))
    o = p.groupBy("program").agg(F.count("*").alias("departments"), F.sum("spent").alias("spent"), F.max("spent").alias("lead"))
    lead = V.ratio(F.col("lead"), F.col("spent"))
    kind = F.when((F.col("departments") >= 5) & (lead < 0.5), "overlap").when(F.col("departments") == 1, "gap").otherwise("shared")
    return o.select("program", "departments", "spent", kind.alias("kind"))
