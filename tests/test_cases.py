"""Case state on a stream: as the table, over a restart, and with ageing."""

from datetime import datetime, timedelta

from ledgerlark.streaming import cases

SCHEMA = "case_id long, status string, created_at timestamp, seq long"
T0 = datetime(2024, 1, 1)


def run(spark, folder, tmp_path, stale):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = cases.case_changes(stream, stale).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def test_stream_equals_table_over_a_restart(spark, tmp_path):
    rows = [(c, s, T0 + timedelta(minutes=10 * i + c), 10 * i + c) for i, s in enumerate(["new", "new", "in_review", "escalated", "escalated", "cleared"]) for c in range(4) if (i + c) % 5]
    folder = str(tmp_path / "in")
    first, later = [r for r in rows if r[3] < 30], [r for r in rows if r[3] >= 30]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(folder)
    run(spark, folder, tmp_path, timedelta(days=300))
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, folder, tmp_path, timedelta(days=300))
    want = sorted(map(tuple, cases.case_changes_of(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == want


def test_a_silent_case_is_stale_once_and_wakes(spark, tmp_path):
    folder = str(tmp_path / "in")
    for days, case, status in ((0, 1, "new"), (1, 2, "new"), (20, 2, "in_review"), (45, 3, "new"), (46, 1, "cleared"), (50, 3, "closed")):
        spark.createDataFrame([(case, status, T0 + timedelta(days=days), days)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, folder, tmp_path, timedelta(days=15))
    of_one = [(r[1], r[2], (r[3] - T0).days, r[4]) for r in got if r[0] == 1]
    assert sorted(of_one, key=lambda x: x[2]) == [(None, "new", 0, 1), ("new", "stale", 15, 1), ("new", "cleared", 46, 2)]
    assert [(r[1], r[2], (r[3] - T0).days) for r in sorted(got, key=lambda x: x[3]) if r[0] == 2 and r[2] == "stale"] == [("new", "stale", 16), ("in_review", "stale", 35)]
