"""Written tables that cut the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A parameter: about as many rows are one task's where rows are wide or sorted whole.
TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no temporary folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a reread, not a recomputation, and an iterative
    plan stays short. ``release`` removes a table that nothing reads any more;
    the cluster removes the rest with its other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of written tables, once whatever was read from them has itself been written."""
    for table in tables:
        path = vars(table).get("written_to")
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def dealt(rows: DataFrame, *by: str, count: int | None = None, least: int = 1) -> DataFrame:
    """Rows dealt by the columns, about ``TASK_ROWS`` a task, so that a task's memory does not grow with the table. Partitions of a fixed number and joined ones do.

    ``count`` is the number of rows; without it they are counted, which for
    stored tables reads footers alone. Few rows stay as they are.
    """
    n = -(-(rows.count() if count is None else count) // TASK_ROWS)
    return rows.repartition(max(n, least, rows.sparkSession.sparkContext.defaultParallelism), *by) if n > 1 else rows
