"""Circles of a directed graph, without its closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out, again and again until all have."""
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, e.count()
        if n == before:
            break
    return e


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node on a circle of edges (src, dst): component is the least node that it reaches and that
    reaches it. Loops are circles; null ends and repeated edges don't matter; no circles give no rows.

    Ends are trimmed; then each node takes the least node that reaches it as its colour, and what reaches the node of its own
    colour within that colour is one component. Components go and the rest is trimmed and coloured again. Every table has a
    row for a node or an edge at most, however many pairs reach each other.
    """
    e, done = _trimmed(cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())), None
    while not e.isEmpty():
        colour = cut(e.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        new = colour
        while not new.isEmpty():
            met = e.join(new.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
            new = cut(met.join(colour, "node").where("least < colour").select("node", F.col("least").alias("colour")))
            colour = cut(colour.join(new.select("node"), "node", "left_anti").unionByName(new))
        ends = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = cut(ends.where("a = b").select("src", "dst", F.col("a").alias("component")))
        reached = cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        new = reached
        while not new.isEmpty():
            back = inner.join(new.select(F.col("node").alias("dst"), "component"), ["dst", "component"]).select(F.col("src").alias("node"), "component").distinct()
            new = cut(back.join(reached, ["node", "component"], "left_anti"))
            reached = cut(reached.unionByName(new))
        # A colour's own node stands alone where no edge within the colour leads to it.
        real = reached.join(inner.join(reached.withColumnRenamed("node", "src"), ["src", "component"]).select("component").where("src = component").distinct(), "component", "left_semi")
        real = real.select("node", "component")
        done = real if done is None else done.unionByName(real)
        gone = reached.select("node")
        e = _trimmed(cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    return done if done is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
