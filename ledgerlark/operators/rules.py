"""Declarative checks of wide numeric filings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Identity:
    """``total`` equals the sum of ``parts`` within ``tolerance``; ``one_sided``: the parts may only not exceed it."""

    name: str
    total: str
    parts: tuple[str, ...]
    tolerance: float = 1
    one_sided: bool = False

    def violation(self) -> Column:
        """The failure mode, null if none: no total beside parts, parts missing, or a sum that is off."""
        t = F.col(self.total)
        s = F.coalesce(F.col(self.parts[0]), F.lit(0))
        for p in self.parts[1:]:
            s = s + F.coalesce(F.col(p), F.lit(0))
        some = F.greatest(*(F.col(p).isNotNull().cast("int") for p in self.parts), F.lit(0)) == 1
        off = (s - t > self.tolerance) if self.one_sided else (F.abs(s - t) > self.tolerance)
        return F.when(t.isNull() & some, "TOTAL_MISSING").when(t.isNotNull() & ~some & (F.abs(t) > self.tolerance), "PARTS_MISSING").when(t.isNotNull() & some & off, "SUM_MISMATCH")


def identity_violations(filings: DataFrame, rules: Sequence[Identity], keys: Sequence[str]) -> DataFrame:
    """(keys, rule, failure): all rules in one pass over the filings."""
    found = F.filter(F.array(*(F.struct(F.lit(r.name).alias("rule"), r.violation().alias("failure")) for r in rules)), lambda x: x["failure"].isNotNull())
    return filings.select(*keys, F.explode(found).alias("x")).select(*keys, "x.rule", "x.failure")


def implausible_fields(filings: DataFrame, fields: Sequence[str], keys: Sequence[str], most: float = 1e10, exempt: Column | None = None) -> DataFrame:
    """(keys, field, value) of amounts beyond ``most``: fields are turned to rows and filtered in one pass."""
    rows = filings if exempt is None else filings.where(~exempt)
    each = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)), lambda x: x["value"] > most)
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.field", "x.value")


def ratio_flags(filings: DataFrame, keys: Sequence[str], expenditure: str, revenue: str, compensation: str, times: float = 100) -> DataFrame:
    """(keys, flag) where spending is out of all proportion."""
    e, r, c = F.col(expenditure), F.col(revenue), F.col(compensation)
    flags = F.array_compact(F.array(F.when((r > 0) & (e > r * times), "EXPENDITURE_OVER_REVENUE"), F.when((e > 0) & (c > e), "COMPENSATION_OVER_EXPENDITURE")))
    return filings.select(*keys, F.explode(flags).alias("flag"))


def schedule_equalities(main: DataFrame, schedule: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], tolerance: float = 1) -> DataFrame:
    """(keys, field, main_value, schedule_value) where a figure differs between a filing and its schedule."""
    j = main.select(*keys, *(F.col(a).alias(f"m{i}") for i, (a, _) in enumerate(pairs))).join(schedule.select(*keys, *(F.col(b).alias(f"s{i}") for i, (_, b) in enumerate(pairs))), list(keys))
    each = F.filter(F.array(*(F.struct(F.lit(a).alias("field"), F.col(f"m{i}").alias("main_value"), F.col(f"s{i}").alias("schedule_value")) for i, (a, _) in enumerate(pairs))), lambda x: F.abs(x["main_value"] - x["schedule_value"]) > tolerance)
    return j.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def schedule_dependency(main: DataFrame, schedule: DataFrame, keys: Sequence[str], needs: Column) -> DataFrame:
    """(keys, problem): a filing that needs the schedule and lacks it, or has one without need."""
    s = schedule.select(*keys).distinct()
    lacks = main.where(needs).join(s, list(keys), "left_anti").select(*keys, F.lit("SCHEDULE_MISSING").alias("problem"))
    extra = main.where(~F.coalesce(needs, F.lit(False))).join(s, list(keys), "left_semi").select(*keys, F.lit("SCHEDULE_NOT_NEEDED").alias("problem"))
    return lacks.unionByName(extra)
