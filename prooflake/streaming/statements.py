"""Statements of documents that arrive chunk by chunk, in any number of micro-batches, with what a document carries on: the
wordings seen, the next number, and the predicates that its statements so far use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cues import retyped
from ..functions.formulas import predicates
from ..operators.segment import dedup_key
from ..operators.translate import formula
from ..sources.extraction import statements

OUT = "doc_id string, stmt_id string, chunk_ix long, type string, text string, original string, inventory array<string>"
STATE = "n int, seen array<string>, inventory array<string>"


def extracted(chunks: DataFrame) -> DataFrame:
    """Statements of chunks (doc_id, chunk_ix, raw), raw what the extractor returned: doc_id, chunk_ix, pos, type, text,
    original, key, uses. Column code, for tables and streams alike."""
    s = statements(chunks.select(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_ix").cast("long").alias("chunk_ix")).alias("doc_id"), "raw"), numbered=False)
    s = s.select("doc_id.doc_id", "doc_id.chunk_ix", F.col("pos").cast("long").alias("pos"), retyped(F.col("type"), F.col("text")).alias("type"), "text", F.col("original_text").alias("original"))
    uses = F.coalesce(predicates(formula(F.col("text"))), F.array().cast("array<string>"))
    return s.withColumn("key", F.sha1(dedup_key(F.col("text")).cast("binary"))).withColumn("uses", uses).where(dedup_key(F.col("text")) != "")


def carried(rows: DataFrame) -> DataFrame:
    """OUT for a stream of extracted() rows: the first statement of each wording of a document, numbered s1, s2, ... in order of
    chunks and places, each with the inventory of predicates that the document had before it, in order of first use.

    Chunks of a document arrive in their order; how they are cut into batches doesn't matter, and a chunk that is sent again
    gives nothing. The state of a document is a digest for each of its wordings and its inventory."""

    def step(key: tuple, frames: Iterator, state) -> Iterator:  # noqa: ANN001
        import pandas as pd

        n, seen, inventory = state.get if state.exists else (0, [], [])
        known, names = set(seen), list(inventory)
        out = []
        for r in pd.concat(list(frames)).sort_values(["chunk_ix", "pos"]).itertuples():
            if r.key not in known:
                known.add(r.key)
                n += 1
                out.append((key[0], f"s{n}", r.chunk_ix, r.type, r.text, r.original, list(names)))
                names += [p for p in dict.fromkeys(r.uses) if p not in names]
        state.update((n, sorted(known), names))
        yield pd.DataFrame(out, columns=["doc_id", "stmt_id", "chunk_ix", "type", "text", "original", "inventory"])

    return rows.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def stream_statements(chunks: DataFrame, sink: str, checkpoint: str):
    """Appends carried statements of a stream of chunks to Parquet at sink; what has come is worked off, then it ends. Started
    again with the same checkpoint it goes on where it was."""
    return carried(extracted(chunks)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
