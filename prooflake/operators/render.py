"""Pictures and batch summaries of verified statements, put together by Column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shortened, xml_escaped
from .report import conflict_sets, edges, nodes

#: Boxes in a row, and the size of a box with the space around it.
ACROSS, WIDE, HIGH, GAP = 4, 220, 64, 28


def svg(props: DataFrame, across: int = ACROSS) -> DataFrame:
    """(doc_id, svg): a standalone picture per document of (doc_id, stmt_id, type, status, verdict, support, conflict, text).

    Statements are boxes in rows of `across`, in order of their ids; support is a line, membership of a conflict a dashed
    one. A support that names no statement of the document is left out.
    """
    order = W.partitionBy("doc_id").orderBy(F.length("stmt_id"), "stmt_id")
    at = nodes(props).withColumn("k", F.row_number().over(order) - 1)
    at = at.withColumn("x", GAP + (F.col("k") % across) * (WIDE + GAP)).withColumn("y", GAP + F.floor(F.col("k") / across).cast("int") * (HIGH + GAP))
    label = xml_escaped(F.concat("stmt_id", F.lit(" ["), "kind", F.lit("]")))
    box = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" rx="6" fill="%s" stroke="%s"/><text x="%d" y="%d" font-weight="bold">%s</text><text x="%d" y="%d">%s</text>',
                          "x", "y", F.lit(WIDE), F.lit(HIGH), "fill", "border", F.col("x") + 10, F.col("y") + 24, label, F.col("x") + 10, F.col("y") + 46, xml_escaped(shortened(F.coalesce("text", F.lit("")), 30)))
    boxes = at.select("doc_id", F.lit(1).alias("part"), F.col("k").alias("a"), F.lit(0).alias("b"), box.alias("line"), (F.col("x") + WIDE + GAP).alias("w"), (F.col("y") + HIGH + GAP).alias("h"))
    spot = lambda end: at.select("doc_id", F.col("stmt_id").alias(end), F.col("k").alias(f"{end}_k"), (F.col("x") + WIDE // 2).alias(f"{end}_x"), (F.col("y") + HIGH // 2).alias(f"{end}_y"))
    ends = edges(props).join(spot("src"), ["doc_id", "src"]).join(spot("dst"), ["doc_id", "dst"])
    style = F.when(F.col("label") == "support", ' stroke="#5f5e5a"').otherwise(' stroke="#a32d2d" stroke-dasharray="5 4"')
    line = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"%s/>', "src_x", "src_y", "dst_x", "dst_y", style)
    lines = ends.select("doc_id", F.lit(0).alias("part"), F.col("src_k").alias("a"), F.col("dst_k").alias("b"), line.alias("line"), F.lit(0).alias("w"), F.lit(0).alias("h"))
    g = boxes.unionByName(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))).alias("l"), F.max("w").alias("w"), F.max("h").alias("h"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" font-family="sans-serif" font-size="13">', "w", "h")
    return g.select("doc_id", F.array_join(F.concat(F.array(head), F.transform("l", lambda s: s["line"]), F.array(F.lit("</svg>"))), "\n").alias("svg"))


def batch_summary(props: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, statements, quarantined, inconsistent_sets, screener_flags, line) for each document of props; flags is what
    the screener returned. line is the row of a console report."""
    sizes = props.groupBy("doc_id").agg(F.count("*").alias("statements"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    sets = conflict_sets(props).groupBy("doc_id").agg(F.count("*").alias("inconsistent_sets"))
    found = flags.groupBy("doc_id").agg(F.count("*").alias("screener_flags"))
    out = sizes.join(sets, "doc_id", "left").join(found, "doc_id", "left").fillna(0, ["inconsistent_sets", "screener_flags"])
    line = F.concat(F.rpad(F.col("doc_id").cast("string"), 24, " "), *[F.lpad(F.col(c).cast("string"), 20, " ") for c in ("statements", "quarantined", "inconsistent_sets", "screener_flags")])
    return out.withColumn("line", line)
