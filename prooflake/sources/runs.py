"""What a run leaves: tables and texts in one folder, resumed by key, and the time of each stage."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of todo whose keys are not done yet. Null keys are equal to nothing and stay."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_run(path: str, tables: dict[str, DataFrame], texts: dict[str, DataFrame] | None = None) -> None:
    """Writes each table as Parquet to <path>/<name>, and each of texts, (doc_id, text), as JSON lines. A name that is there
    already is written anew; the executors write their own parts."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, df in (texts or {}).items():
        df.select(F.col("doc_id").cast("string").alias("doc_id"), "text").write.mode("overwrite").json(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


class Stages:
    """Wall-clock seconds of named stages of the driver, in order; a name that comes again is a row of its own."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, round(time.perf_counter() - start, 3)))

    def table(self, spark: SparkSession) -> DataFrame:
        """(ix, stage, seconds, share of the whole)."""
        whole = sum(s for _, s in self.rows) or 1.0
        rows = [(i, n, s, round(s / whole, 4)) for i, (n, s) in enumerate(self.rows)]
        return spark.createDataFrame(rows, "ix int, stage string, seconds double, share double")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
