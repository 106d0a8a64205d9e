"""Scores on rows that some year or source leaves unstated."""

from ledgerlark.operators import scores as S


def test_latest_deferred_is_the_latest_stated_one(spark):
    granted = spark.createDataFrame([(1, 150000.0), (2, 150000.0)], "bn long, amount double")
    filed = spark.createDataFrame([(1, 2000, None, 10.0), (1, 2001, None, 60000.0), (1, 2002, None, None), (2, 2000, None, None)], "bn long, year int, revenue double, deferred double")
    assert {r.bn: r.flag for r in S.reconcile_cumulative(granted, filed).collect()} == {1: "MUCH_HIGHER", 2: "REPORTS_ZERO"}
