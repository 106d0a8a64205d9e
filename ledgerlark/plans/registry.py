"""Registry of named queries with the operators they exercise and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import oracle


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def plain_types(rows: DataFrame) -> DataFrame:
    """Integers as long, decimals as double and dates as text, so that results compare across engines."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return rows.select(*out)


def query(name: str, operators: str, sql: str | None = None):
    """Register a builder of (spark, folder) under a name."""

    def wrap(build):
        QUERIES[name] = Query(name, lambda spark, folder: plain_types(build(spark, folder)), oracle(sql) if sql else None, tuple(operators.split()))
        return build

    return wrap
