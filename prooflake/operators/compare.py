"""Runs beside each other, and documents made for comparing them: differences, missing runs, balanced cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .translate import negation

#: Hex digits of a hash that a cell's histogram is by.
DIGITS = 3


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two stores (doc_id, stmt_id, status, verdict) by document: doc_id, accepted_before and accepted_after (shares of the
    statements that each has, null for none), changed (statements of both with another status or verdict), only_before,
    only_after. stmt_id is unique within a document of a store."""
    side = lambda df, s: df.select("doc_id", "stmt_id", F.col("status").alias(f"status_{s}"), F.col("verdict").alias(f"verdict_{s}"), F.lit(True).alias(f"in_{s}"))
    met = side(before, "a").join(side(after, "b"), ["doc_id", "stmt_id"], "full")
    share = lambda s: F.avg(F.when(F.col(f"in_{s}"), (F.col(f"status_{s}") == "accepted").cast("double")))
    both = F.col("in_a") & F.col("in_b")
    moved = ~F.col("status_a").eqNullSafe(F.col("status_b")) | ~F.col("verdict_a").eqNullSafe(F.col("verdict_b"))
    return met.groupBy("doc_id").agg(share("a").alias("accepted_before"), share("b").alias("accepted_after"), F.count_if(both & moved).alias("changed"), F.count_if(F.col("in_b").isNull()).alias("only_before"), F.count_if(F.col("in_a").isNull()).alias("only_after"))


def missing(manifest: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Rows of the manifest (distinct keys) that results has none for: the runs that did not take place."""
    return manifest.select(*keys).distinct().join(results.select(*keys).distinct(), list(keys), "left_anti")


def balanced(rows: DataFrame, n: int, *cell: str, key: Column) -> DataFrame:
    """n rows of each cell (all of a smaller one), those of the least keys; key is text that is distinct in a cell and spread like
    a hash in hex. A null cell is a cell.

    One pass counts each cell's keys by their first DIGITS digits; where the counts pass n is the only part of a cell whose
    rows are put in order, a 4,096th of it."""
    kept = rows.withColumn("_key", key).withColumn("_head", F.substring("_key", 1, DIGITS)).withColumn("_cell", F.to_json(F.struct(*cell), {"ignoreNullFields": "false"}))
    part = W.partitionBy("_cell").orderBy("_head")
    upto = kept.groupBy("_cell", "_head").agg(F.count("*").alias("_many")).withColumn("_upto", F.sum("_many").over(part))
    ends = upto.where(F.col("_upto") - F.col("_many") < n).select("_cell", "_head", (n - (F.col("_upto") - F.col("_many"))).alias("_left"), (F.col("_upto") <= n).alias("_whole"))
    met = kept.join(ends, ["_cell", "_head"])
    edge = met.where("NOT _whole").withColumn("_nth", F.row_number().over(W.partitionBy("_cell").orderBy("_key"))).where("_nth <= _left")
    return met.where("_whole").select(*rows.columns).unionByName(edge.select(*rows.columns))


def consistency(items: DataFrame) -> DataFrame:
    """Entailment items (doc_id, text, conclusion, label) as documents (doc_id, text, expected): the text with the conclusion's
    denial after it contradicts itself (1) where the label is True, and doesn't (0) where it is Unknown or Uncertain. Items
    labelled otherwise, and those whose conclusion has no denial, go."""
    expected = F.when(F.col("label") == "True", 1).when(F.col("label").isin("Unknown", "Uncertain"), 0)
    rows = items.withColumn("expected", expected).withColumn("denial", negation(F.col("conclusion")))
    kept = rows.where("expected IS NOT NULL AND denial IS NOT NULL")
    return kept.select(*[c for c in items.columns if c not in ("text", "conclusion", "label")], F.concat_ws(" ", "text", "denial").alias("text"), "expected")
