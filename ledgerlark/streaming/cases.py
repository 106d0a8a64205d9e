"""Review cases as keyed state: each case keeps its decisions, and ages when none comes.

Decisions are rows (case_id, status, created_at, seq). A change of status is
told with the one before; a case that hears nothing for ``stale_after`` of event
time is told as stale once, and is fresh again with its next decision. State
lives in the state store and survives a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE = "stale"
CHANGES = "case_id long, old_status string, new_status string, at timestamp, decisions long"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CaseProcessor(StatefulProcessor):
    """``now`` is the present status with its time and whether it is stale; ``log`` the decisions that changed it, in order."""

    def __init__(self, stale_after: timedelta) -> None:
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, at timestamp, stale boolean")
        self.log = handle.getListState("log", "seq long, status string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "seq"])
        status, last, stale = self.now.get() if self.now.exists() else (None, None, False)
        told = sum(1 for _ in self.log.get()) if self.log.exists() else 0
        out = []
        for seq, new, at in batch[["seq", "status", "created_at"]].itertuples(index=False):
            at = at.to_pydatetime()
            if last is not None and not stale and at > last + self.stale_after:  # its timer had no batch to fire in
                out.append((key[0], status, STALE, last + self.stale_after, told))
            last, stale = at if last is None or at > last else last, False
            if new != status:
                self.log.appendValue((int(seq), new, at))
                told += 1
                out.append((key[0], status, new, at, told))
                status = new
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.now.update((status, last, False))
        self.handle.registerTimer(int((last + self.stale_after).timestamp() * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, stale = self.now.get()
        out = []
        if not stale:
            self.now.update((status, last, True))
            told = sum(1 for _ in self.log.get())
            out.append((key[0], status, STALE, last + self.stale_after, told))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        """The handle owns what there is to close."""


def case_changes(decisions: DataFrame, stale_after: timedelta = timedelta(days=30), late: str = "1 hour") -> DataFrame:
    """Changes of a stream of decisions. Decisions later than ``late`` behind the newest are dropped by the watermark."""
    decisions.sparkSession.conf.set(*STORE)  # the keyed state of several variables needs this store
    rows = decisions.withWatermark("created_at", late)
    return rows.groupBy("case_id").transformWithStateInPandas(CaseProcessor(stale_after), CHANGES, "Append", "EventTime")


def case_changes_of(decisions: DataFrame) -> DataFrame:
    """The same changes of a whole table, without ageing: (case_id, old_status, new_status, at, decisions)."""
    by = Window.partitionBy("case_id").orderBy("created_at", "seq")
    changed = decisions.withColumn("old_status", F.lag("status").over(by)).where(~F.col("status").eqNullSafe(F.col("old_status")))
    return changed.select("case_id", "old_status", F.col("status").alias("new_status"), F.col("created_at").alias("at"), F.row_number().over(by).cast("long").alias("decisions"))
