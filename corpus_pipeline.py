"""A corpus pipeline of five stages over documents: quality, near-duplicates, repeated strings, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet into the shared
folder and reads it back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prooflake.llm import mixing, near_copies, pieces, quality, suffix_dedup
from prooflake.llm.common import read, shared_dir
from prooflake.llm.queries import TOKENIZER


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, likeness 0.8 or more, candidates by SimHash and
    vantage-point trees and, beyond their radius, by MinHash bands."""
    return near_copies.keep_one(docs)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere."""
    return suffix_dedup.removed(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass over a document."""
    return mixing.mixed(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each row, by merge-dropout: doc_id, n_pieces, ids_sha256, text_sha256, lossless, ids."""
    return pieces.encoded(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("string_dedup", string_dedup),
    ("mix", source_mix),
    ("encode", piece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
