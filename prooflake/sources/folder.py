"""A folder of documents and what belongs to them, met by their stems, and a folder of artefacts, a set for each document.

    <stem>.txt or .md            the text
    <stem>.extraction.json       statements, as an extractor returned them
    <stem>.translation.json      {statement id: formula or null}
    <stem>.bridges.json          [{id, fol, gloss}]

All files are read in one scan by Spark's own reader, wherever the folder is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("extraction", "translation", "bridges")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, raw_text, extraction, translation, bridges, inputs) for each stem that has a text; what is missing is null.
    inputs is a digest of all four. Of two texts of one stem that with the least file name is taken."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    name = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    files = files.select("value", name.alias("file"))
    kind = F.nullif(F.regexp_extract("file", rf"\.({'|'.join(KINDS)})\.json$", 1), F.lit(""))
    text = F.rlike(F.col("file"), F.lit(r"\.(txt|md)$"))
    kind = F.when(kind.isNotNull(), kind).when(text, "raw_text")
    stem = F.regexp_replace("file", rf"(\.({'|'.join(KINDS)})\.json|\.(txt|md))$", "")
    rows = files.select(stem.alias("doc_id"), kind.alias("kind"), "file", "value").where("kind IS NOT NULL")
    one = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("file"))).alias(k)
    met = rows.groupBy("doc_id").agg(*[one(k) for k in ("raw_text", *KINDS)]).where("raw_text IS NOT NULL")
    parts = [F.coalesce(F.sha2(F.col(k), 256), F.lit("-")) for k in ("raw_text", *KINDS)]
    return met.withColumn("inputs", F.sha2(F.concat_ws(" ", *parts), 256))


def write_artefacts(artefacts: DataFrame, path: str) -> None:
    """Writes (doc_id, name, text) as <path>/doc_id=<doc_id>/name=<name>/part-*.txt. Files of a document and name that are there
    are replaced, others stay: a write that was killed and is run again leaves what one write leaves."""
    rows = artefacts.select("doc_id", "name", "text").repartition("doc_id").sortWithinPartitions("doc_id", "name")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "name").text(path)


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of write_artefacts; the texts without line breaks at their ends."""
    schema = "value string, doc_id string, name string"
    rows = spark.read.schema(schema).text(path, wholetext=True)
    return rows.select("doc_id", "name", F.rtrim(F.col("value"), F.lit("\n")).alias("text"))
