"""Reports on verified statements: summaries, conflict sets, and theories as node and edge tables and Graphviz text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shortened

# Fill and border of a node by kind.
COLOURS = {
    "axiom": ("#dbe9ff", "#1f4e9c"),
    "bridge": ("#e7dcfa", "#5b2a91"),
    "entailed": ("#d8f3dc", "#1b6b36"),
    "not_entailed": ("#fff3cd", "#7a5a00"),
    "contradicts": ("#ffd6d6", "#b3202c"),
    "refuted": ("#ffe3c2", "#a04a00"),
    "unknown": ("#eceff1", "#546068"),
    "error": ("#eceff1", "#546068"),
    "excluded": ("#f7f7f7", "#8a8f94"),
}


def kind() -> Column:
    """Role or verdict that a statement (type, status, verdict) is shown by."""
    out = F.when(F.col("status").isin("quarantined", "ambiguous"), "excluded").when(F.col("type").isin("bridge", "axiom"), F.col("type"))
    return out.otherwise(F.coalesce("verdict", F.lit("unknown")))


def summary(props: DataFrame, *by: str) -> DataFrame:
    """Statements by verdict, or by status where there is none."""
    return props.groupBy(*by, F.coalesce("verdict", "status").alias("outcome")).agg(F.count("*").alias("n"))


def _members() -> Column:
    """A contradicting statement and what it contradicts."""
    return F.array_sort(F.array_distinct(F.concat(F.array("stmt_id"), F.coalesce("conflict", F.array().cast("array<string>")))))


def conflict_sets(props: DataFrame) -> DataFrame:
    """Distinct minimal inconsistent sets of (doc_id, stmt_id, type, verdict, conflict): doc_id, members, bridged."""
    sets = props.where("verdict = 'contradicts'").select("doc_id", _members().alias("members")).distinct()
    parts = sets.select("doc_id", "members", F.explode("members").alias("stmt_id"))
    kinds = props.select("doc_id", "stmt_id", (F.col("type") == "bridge").alias("bridge"))
    return parts.join(kinds, ["doc_id", "stmt_id"], "left").groupBy("doc_id", "members").agg(F.coalesce(F.bool_or("bridge"), F.lit(False)).alias("bridged"))


def nodes(props: DataFrame) -> DataFrame:
    """doc_id, stmt_id, kind, fill, border; a member of a conflict keeps its fill and gets the conflict's border."""
    k = F.when(F.col("verdict").isin("contradicts", "refuted"), F.col("verdict")).otherwise(F.col("kind"))
    shade = lambda at: F.create_map(*[F.lit(x) for name, c in COLOURS.items() for x in (name, c[at])])
    rows = props.withColumn("kind", kind())
    return rows.select("doc_id", "stmt_id", "kind", F.element_at(shade(0), F.col("kind")).alias("fill"), F.element_at(shade(1), k).alias("border"), "text")


def edges(props: DataFrame) -> DataFrame:
    """doc_id, src, dst, label: support of a statement, and members of each conflict set to the set's first member."""
    none = F.array().cast("array<struct<label:string,at:int,members:array<string>>>")
    support = F.transform(F.coalesce("support", F.array().cast("array<string>")), lambda s, i: F.struct(F.lit("support").alias("label"), i.alias("at"), F.array(s, "stmt_id").alias("members")))
    conflict = F.when(F.col("verdict") == "contradicts", F.array(F.struct(F.lit("conflict").alias("label"), F.lit(-1).alias("at"), _members().alias("members")))).otherwise(none)
    # props is read once. Each statement of a set has it; repeated support stays.
    sets = props.select("doc_id", F.inline(F.concat(support, conflict))).groupBy("doc_id", "label", "at", "members").agg(F.count("*").cast("int").alias("n"))
    src = F.when(F.col("label") == "support", F.array_repeat(F.get("members", F.lit(0)), F.col("n"))).otherwise(F.col("members"))
    dst = F.when(F.col("label") == "support", F.get("members", F.lit(1))).otherwise(F.get("members", F.lit(0)))
    return sets.select("doc_id", F.explode(src).alias("src"), dst.alias("dst"), "label").where("label = 'support' OR src <> dst")


def dot(props: DataFrame) -> DataFrame:
    """(doc_id, dot): one Graphviz digraph per document."""
    label = F.replace(F.concat("stmt_id", F.lit(" ["), "kind", F.lit("] "), shortened(F.col("text"), 40)), F.lit('"'), F.lit("'"))
    n = nodes(props).select("doc_id", F.lit(0).alias("part"), F.format_string('  "%s" [label="%s", fillcolor="%s", color="%s"];', "stmt_id", label, "fill", "border").alias("line"))
    style = F.when(F.col("label") == "support", "#5f5e5a").otherwise("#a32d2d")
    e = edges(props).select("doc_id", F.lit(1).alias("part"), F.format_string('  "%s" -> "%s" [color="%s", label="%s"];', "src", "dst", style, "label").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda s: s["line"])
    head = F.array(F.lit("digraph theory {"), F.lit("  rankdir=TB;"))
    return n.unionByName(e).groupBy("doc_id").agg(F.array_join(F.concat(head, lines, F.array(F.lit("}"))), "\n").alias("dot"))


def scored(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Gold (doc_id, expected) with what was found; a document without a result is null, which the matrix counts as an error."""
    return gold.join(results.select("doc_id", "found"), "doc_id", "left")


def run_means(runs: DataFrame, *by: str) -> DataFrame:
    """Means of per-document ratios over (doc_id, statements, quarantined, tokens, seconds)."""
    rate = F.when(F.col("statements") > 0, F.col("quarantined") / F.col("statements"))
    return runs.groupBy(*by).agg(F.avg(rate).alias("quarantine_rate"), F.avg("tokens").alias("tokens_per_doc"), F.avg("seconds").alias("seconds_per_doc"), F.sum("tokens").alias("tokens"))
