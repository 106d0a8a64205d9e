"""Entry points of the driver."""

import __spark_entry__ as entry


def test_flagship_gives_rows(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and got.columns == ["department", "program", "entity_count", "total_dollars", "hhi", "cr4", "top_share", "effective_competitors", "top_entities", "valid"]
    assert got.where("not valid").count() == 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(map(callable, entry.queries().values()))
