"""Readers, sinks and streams on small files."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.sources import readers as R
from ledgerlark.sources import sinks as S
from ledgerlark.streaming import events as V


def test_csv_with_quotes_and_a_gate(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name\n1,"a, ""quoted""\nline"\nx,bad\n3,c\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    rows = R.csv(spark, str(path), schema, max_bad=1).orderBy("name").collect()
    assert [r.name for r in rows if r.id] == ['a, "quoted"\nline', "c"]
    with pytest.raises(ValueError):
        R.csv(spark, str(path), schema, max_bad=0)


def test_headers_and_crosswalk(spark):
    assert R.header_names([" Total Amount ", "2020", "", "total amount"]) == ["total_amount", "field_2020", "field", "total_amount_2"]
    rows = spark.createDataFrame([(" x ",)], "`Legal Name` string")
    assert R.crosswalk(rows, {"name": ("legal name", lambda c: F.trim(c))}).first().name == "x"
    with pytest.raises(ValueError):
        R.crosswalk(rows, {"name": ("other", lambda c: c)})


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "n": {"$numberLong": "9999999"}}, {"a": 2}]')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("n", T.StringType())])
    rows = R.json_array(spark, str(tmp_path / "a.json"), schema)
    assert {(r.a, r.v) for r in rows.select("a", R.extended_scalar(F.col("n")).alias("v")).collect()} == {(1, "9999999"), (2, None)}


def test_zip_and_xlsx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("small.csv", "a\n1\n")
        z.writestr("big.CSV", "a\n1\n2\n")
        z.writestr("note.txt", "x")
    assert [r.member for r in R.unzipped(spark, str(tmp_path / "a.zip")).collect()] == ["big.CSV", "small.csv"]
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + f'<row r="1">{cell("A1", "Title")}</row><row r="2">{cell("A2", "Name")}{cell("B2", "Total $")}</row><row r="3">{cell("A3", "x")}<c r="B3"><v>5</v></c></row></sheetData></worksheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    row = R.xlsx(spark, str(tmp_path / "b.xlsx")).first()
    assert row.row == 3 and row.cells == {"name": "x", "total__": "5"}


def test_registry_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<r><corporation corporationId="7"><names><name current="false">Old</name><name current="true">New </name></names><statuses><status code="1" current="true">Active</status></statuses><activities><activity date="2001-02-03" code="A"/><activity date="2005-01-01" code="B"/></activities></corporation></r>')
    nested = lambda name, inner: T.StructField(name, T.StructType([T.StructField(name[:-2] if name.endswith("ses") else "activity" if name == "activities" else name[:-1], inner)]))
    fields = {f.name: f.dataType for f in R.REGISTRY.fields}
    schema = T.StructType([T.StructField("_corporationId", T.StringType()), nested("names", fields["names"]), nested("statuses", fields["statuses"]), nested("activities", fields["activities"])])
    raw = R.xml_rows(spark, str(tmp_path / "r.xml"), "corporation", schema)
    flat = raw.select("_corporationId", F.col("names.name").alias("names"), F.col("statuses.status").alias("statuses"), F.col("activities.activity").alias("activities"))
    got = R.registry_rows(flat).first()
    assert (got.corporation_id, got.name, got.status_code, got.last_activity, got.last_activity_code) == ("7", "New", "1", dt.date(2005, 1, 1), "B")


def test_feeds(spark):
    body = "<rss><item><title><![CDATA[A &amp; B]]></title><link>u</link><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>C</title></item></rss>"
    rows = R.feed_items(spark.createDataFrame([(body,)], "body string"), "body").collect()
    assert rows[0].title == "A & B" and rows[0].link == "u" and rows[1].title == "C" and rows[1].link is None


def test_pages_are_fetched_once(spark):
    landed = spark.createDataFrame([(10,)], "offset long")
    pages = R.offsets_to_fetch(spark, 25, 10, landed)
    assert {r.body for r in R.fetch_pages(pages, lambda o, n: f"{o}+{n}").collect()} == {"0+10", "20+10"}


def test_loads(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k long, v string")
    good, bad = S.load_new(rows, spark.createDataFrame([(3, "z")], "k long, v string"), ["k"], F.col("v").isNotNull())
    assert [r.k for r in good.collect()] == [1] and [r.k for r in bad.collect()] == [2]


def test_rebuild_refuses_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    S.rebuild(spark.range(3), path)
    with pytest.raises(ValueError):
        S.rebuild(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 3


def test_decisions_append_only_changes(spark):
    log = spark.createDataFrame([("a", "new", "2020-01-01", 1), ("a", "in_review", "2020-01-02", 2)], "case_id string, status string, created_at string, seq long")
    new = spark.createDataFrame([("a", "in_review", "2020-01-03", 3), ("a", "cleared", "2020-01-03", 4), ("b", "odd", "2020-01-03", 5), ("b", "new", "2020-01-03", 6)], log.schema)
    assert {r.seq for r in S.append_decision(log, new).collect()} == {4, 6}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    events.select(F.col("event_id").cast("long"), "ts", F.col("user_id").cast("long"), "event_type", "value", "props").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(10**9, dt.datetime(2100, 1, 1), 1, "view", 0.0, "{}")], V.EVENTS)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = V.tumbling(V.read_events(spark, str(tmp_path / "in"), 10))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.event_type): r.events for r in spark.table("windows").collect()}
    want = {(r.window_start, r.event_type): r.events for r in V.tumbling(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_status_changes_of_a_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0), 7, "view", 0.0, ""), (2, dt.datetime(2024, 1, 1, 1), 7, "view", 0.0, ""), (3, dt.datetime(2024, 1, 1, 2), 7, "error", 0.0, ""), (4, dt.datetime(2024, 1, 1, 0), 8, "click", 0.0, "")]
    spark.createDataFrame(rows, V.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = V.status_changes(V.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.old_status, r.new_status) for r in spark.table("changes").collect()} == {(7, None, "view"), (7, "view", "error"), (8, None, "click")}


def test_latest_row_per_key_of_a_stream(spark, tmp_path):
    for k, (ts, kind) in enumerate([(1, "view"), (3, "error"), (2, "click")]):
        spark.createDataFrame([(k, dt.datetime(2024, 1, ts), 7, kind, 0.0, "")], V.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    V.keep_latest(V.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), "user_id", "ts").awaitTermination()
    assert [r.event_type for r in spark.read.parquet(str(tmp_path / "out" / "version=2")).collect()] == ["error"]
