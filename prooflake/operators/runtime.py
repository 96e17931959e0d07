"""Checkpoints and numbers of tasks for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task is dealt, about.
TASK_ROWS = 1_000_000


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; a local one is made only where that is unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    at = sc.getConf().get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else tempfile.mkdtemp(prefix="prooflake-"))
    if not current.isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: more rows make more tasks, not larger ones."""
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)
