"""Event-time extensions: windows, repeats, snapshots and state changes on streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in micro-batches of a bounded number of files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by window and type; works on a stream and on a table alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step))
    return w.agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per user and session: events and value between pauses of at least ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "value")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a repeated ingest changes nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def status_changes(events: DataFrame, key: str = "user_id", status: str = "event_type") -> DataFrame:
    """(key, old_status, new_status, ts): changes of a key's status; repeats of the present one are no change."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = []
        for batch in batches:
            for ts, new in batch.sort_values(["ts", "event_id"])[["ts", status]].itertuples(index=False):
                if new != now:
                    rows.append((k[0], now, new, ts))
                    now = new
        state.update((now,))
        yield pd.DataFrame(rows, columns=[key, "old_status", "new_status", "ts"])

    schema = f"{key} long, old_status string, new_status string, ts timestamp"
    return events.groupBy(key).applyInPandasWithState(run, schema, "now string", "append", GroupStateTimeout.NoTimeout)


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """Write the latest row of each key to ``path``, one version folder per micro-batch; a replayed batch overwrites its own."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/version={n - 1}") if n else None
        both = batch if old is None else old.unionByName(batch)
        best = both.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/version={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
