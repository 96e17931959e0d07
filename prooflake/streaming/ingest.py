"""Incremental runs: a stream of documents goes through the statement stages batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import gate
from ..operators.segment import sentences


def stream_gate(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Reads new Parquet files of documents (doc_id, text) and appends gated statements; available-now, exactly once per file."""

    def statements(docs: DataFrame) -> DataFrame:
        s = sentences(docs).selectExpr("doc_id", "cast(ix as string) AS stmt_id", "'axiom' AS type", "sentence AS text")
        return gate(s)

    stream = spark.readStream.schema(schema).parquet(source)
    return (transform or statements)(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
