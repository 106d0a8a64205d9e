"""Sinks: keyed loads, merges, rebuilds, exports and append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlark.operators.latest import first_per_key


def load_new(rows: DataFrame, existing: DataFrame, key: Sequence[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows set aside): conflicts with stored keys are ignored, invalid rows kept for review."""
    good = rows.where(F.coalesce(valid, F.lit(False)))
    bad = rows.where(~F.coalesce(valid, F.lit(False)))
    return good.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti"), bad


class GateClosed(ValueError):
    """Too many rows failed; ``counts`` says how many of how many, and by which rule."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(f"{counts['failed']} of {counts['checked']} rows failed: {counts}")
        self.counts = counts


def gated_write(rows: DataFrame, rules: dict[str, Column], path: str, most: float = 0.01) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, quarantined rows, counts) of rows that are written once, apart by whether they pass all rules.

    Failed and checked rows are counted by the pass that writes. A rule that is
    null has failed. Where more than the share ``most`` fails nothing stays
    written and ``GateClosed`` is raised.
    """
    spark = rows.sparkSession
    failed = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    why = F.array_compact(F.array(*(F.when(f, F.lit(name)) for name, f in failed.items())))
    seen = Observation()
    marked = rows.withColumn("_why", why).withColumn("_ok", F.size("_why") == 0)
    counted = [F.count("*").alias("checked"), F.count_if(~F.col("_ok")).alias("failed"), *(F.count_if(F.array_contains("_why", name)).alias(f"failed_{name}") for name in failed)]
    marked.observe(seen, *counted).write.partitionBy("_ok").parquet(path)
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    if counts["failed"] > most * counts["checked"]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise GateClosed(counts)
    stored = spark.read.schema(marked.schema).parquet(path)
    return stored.where("_ok").drop("_ok", "_why"), stored.where("not _ok").drop("_ok"), counts


def upsert(existing: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``existing`` with the changed rows replaced and the new ones added; null changes keep the stored value."""
    values = [c for c in existing.columns if c not in key]
    new = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in values if c in changes.columns))
    j = existing.join(new, list(key), "full")
    return j.select(*(F.col(c) if c in key else F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in existing.columns))


def enrich(rows: DataFrame, updates: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with columns taken from the updates where they have a value."""
    new = updates.select(*key, *(F.col(c).alias(f"_u_{c}") for c in columns))
    return rows.join(new, list(key), "left").select(*(F.coalesce(f"_u_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def keep_where_exists(rows: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(others.select(*key).distinct(), list(key), "left_semi")


def delete_using(rows: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(others.select(*key).distinct(), list(key), "left_anti")


def rebuild(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a derived table; a plan that reads the target cannot be written to it."""
    bare = lambda p: "/" + p[5:].lstrip("/") if p.startswith("file:") else p.rstrip("/")
    if any(bare(f).startswith(bare(path) + "/") for f in rows.inputFiles()):
        raise ValueError("a table cannot be rebuilt from itself")
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export(rows: DataFrame, path: str, form: str = "parquet", order: Sequence[str | Column] = ()) -> None:
    """Write a report; ordered output is one range-sorted set of files."""
    out = rows.orderBy(*order) if order else rows
    w = out.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", True).option("escape", '"').csv(p)}[form](path)


def markdown(rows: DataFrame, order: Sequence[str | Column], n: int = 50, drop: Sequence[str] = ()) -> str:
    """The first ``n`` rows as a Markdown table, without the columns that only order it."""
    cols = [c for c in rows.columns if c not in drop]
    lines = [[str(r[c]) if r[c] is not None else "" for c in cols] for r in rows.orderBy(*order).limit(n).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [cols, ["---"] * len(cols), *lines])


# States of a case.
STATES = ("new", "in_review", "escalated", "cleared", "confirmed", "closed")


def append_decision(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that may be appended: known states only, and none that repeats a case's present state.

    Columns: case_id, status, created_at, seq.
    """
    now = latest_status(log).select("case_id", F.col("status").alias("_now"))
    j = decisions.where(F.col("status").isin(*STATES)).join(now, "case_id", "left")
    return j.where(F.col("_now").isNull() | (F.col("_now") != F.col("status"))).drop("_now")


def latest_status(log: DataFrame) -> DataFrame:
    return first_per_key(log, ["case_id"], [F.col("created_at").desc(), F.col("seq").desc()])


def briefs(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(case_id, payload): an append-only row per case with its fields as a variant."""
    return cases.select("case_id", F.parse_json(F.to_json(F.struct(*fields))).alias("payload"))
