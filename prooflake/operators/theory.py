"""Theories as text, put together by joins and windows: outlines of shared derivations, trees of clusters, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shortened
from .report import conflict_sets, kind
from .runtime import cut
from .shapes import MOST, dealt, matched

#: Characters of a statement in a tree.
WIDTH = 56
#: Marks of statements by kind.
MARKS = {"axiom": "AX", "bridge": "BR", "entailed": "OK", "not_entailed": "??", "contradicts": "XX", "refuted": "RA", "unknown": "~?", "error": "ER", "excluded": "--"}


def outline(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, line, depth, node, above): each document's derivation graph written depth first.

    nodes: (doc_id, node, pos); edges: (doc_id, node, part), what a node rests on. Roots are nodes that nothing rests on, in
    order of pos, and so are a node's parts. A node's parts are written where depth-first search first comes to it; elsewhere
    it is one line with above true. What no root leads to (circles) hangs from its first node. Parts that are no node go, and
    repeated rows count once; rows with a null doc_id, node or part are none.

    Lines follow from the order of the nodes and from the edges between their places. So documents of at most MOST rows with
    the same places have one shape, and each shape is walked once; documents of more rows, or with a null pos, are walked
    themselves.
    """
    n, e = nodes.select("doc_id", "node", "pos").dropna(subset=["doc_id", "node"]), edges.select("doc_id", "node", "part").dropna()
    rows = n.select("*", F.lit(None).alias("part")).unionByName(e, allowMissingColumns=True)
    is_node = F.col("part").isNull()
    small, large = dealt(rows, MOST)
    docs = small.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(is_node, F.struct("pos", "node")))).alias("n"), F.collect_set(F.when(~is_node, F.struct("node", "part"))).alias("e"),
        (~F.bool_or(is_node & F.col("pos").isNull())).alias("good"))
    docs = docs.select("doc_id", "e", "good", F.array_distinct(F.transform("n", lambda x: x["node"])).alias("names"))
    at = lambda x: F.array_position("names", x)
    places = F.filter(F.transform("e", lambda x: F.struct(at(x["node"]).alias("a"), at(x["part"]).alias("b"))), lambda p: (p["a"] > 0) & (p["b"] > 0))
    docs = docs.select("doc_id", "good", "names", F.sort_array(places).alias("e"))
    docs = cut(docs.select("doc_id", F.when(F.col("good"), F.to_json(F.struct(F.size("names").alias("n"), "e"))).alias("shape"), F.when(F.col("good"), F.col("names")).alias("names")))
    every = cut(docs.groupBy("shape").agg(F.count("*").alias("n")))
    graphs = every.where("shape IS NOT NULL").select(F.col("shape").alias("doc_id"), F.from_json("shape", "n long, e array<struct<a: long, b: long>>").alias("g")).where("g.n > 0")
    walked = _walked(graphs.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("g.n"))).alias("node")).withColumn("pos", F.col("node")), graphs.select("doc_id", F.explode("g.e").alias("p")).select("doc_id", F.col("p.a").alias("node"), F.col("p.b").alias("part")))
    found = cut(walked.withColumnRenamed("doc_id", "shape").withColumnRenamed("node", "place").join(every, "shape"))
    name = F.get("names", (F.col("place") - 1).cast("int")).alias("node")
    out = matched(docs, every, found).select("doc_id", "line", "depth", name, "above")
    rest = docs.where("shape IS NULL").select("doc_id")
    rest = rest if large is None else rest.unionByName(large)
    if rest.isEmpty():
        return out
    return out.unionByName(_walked(n.join(rest, "doc_id", "left_semi"), e.join(rest, "doc_id", "left_semi")))


def _walked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """outline() of each document by itself.

    The first visit of a node is the least of the paths that lead to it, and so is that path's beginning for the nodes on it.
    So each round gives every node the least of its own path and its parents' paths with its place among their parts, until
    none gets less: as many rounds as the graph is deep, a row for each edge in each, and no path is written twice.
    """
    n = nodes.groupBy("doc_id", "node").agg(F.min("pos").alias("pos"))
    step = lambda c: F.lpad(F.hex(c), 16, "0")
    e = edges.select("doc_id", "node", "part").distinct().join(n.select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    e = e.join(n.select("doc_id", F.col("node").alias("part"), F.col("pos").alias("part_pos")), ["doc_id", "part"])
    place = F.row_number().over(W.partitionBy("doc_id", "node").orderBy("part_pos", "part"))
    e = cut(e.select("doc_id", "node", "part", step(place).alias("place")))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "node"))
    n = cut(n.select("doc_id", "node", step(order).alias("start")))
    roots = n.join(e.select("doc_id", F.col("part").alias("node")), ["doc_id", "node"], "left_anti")
    paths = cut(roots.select("doc_id", "node", F.col("start").alias("path")))
    while True:
        new = paths
        while not new.isEmpty():
            met = new.join(e, ["doc_id", "node"]).select("doc_id", F.col("part").alias("node"), F.concat("path", "place").alias("path"))
            met = met.groupBy("doc_id", "node").agg(F.min("path").alias("path"))
            old = paths.select("doc_id", "node", F.col("path").alias("old"))
            new = cut(met.join(old, ["doc_id", "node"], "left").where("old IS NULL OR path < old").select("doc_id", "node", "path"))
            paths = cut(paths.join(new.select("doc_id", "node"), ["doc_id", "node"], "left_anti").unionByName(new))
        lost = n.join(paths, ["doc_id", "node"], "left_anti")
        first = cut(lost.groupBy("doc_id").agg(F.min_by("node", "start").alias("node"), F.min("start").alias("path")))
        if first.isEmpty():
            break
        # Behind all roots: a digit more than any start has.
        paths = cut(paths.unionByName(first.select("doc_id", "node", F.concat(F.lit("g"), "path").alias("path"))))
    shown = e.join(paths, ["doc_id", "node"]).select("doc_id", F.col("part").alias("node"), F.concat("path", "place").alias("at"))
    own = paths.withColumnRenamed("path", "own")
    tops = paths.select("doc_id", "node", F.col("path").alias("at")).where(F.length(F.ltrim(F.col("at"), F.lit("g"))) == 16)
    lines = shown.unionByName(tops).join(own, ["doc_id", "node"])
    has = e.select("doc_id", "node").distinct().withColumn("has", F.lit(True))
    lines = lines.join(has, ["doc_id", "node"], "left")
    depth = (F.length(F.ltrim(F.col("at"), F.lit("g"))) / 16).cast("int") - 1
    above = (F.col("at") != F.col("own")) & F.coalesce("has", F.lit(False))
    return lines.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).alias("line"), depth.alias("depth"), "node", above.alias("above"))


def _leaf() -> Column:
    mark = F.element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), kind())
    return F.concat(F.lit("["), "stmt_id", F.lit("] "), mark, F.lit(" "), shortened(F.coalesce("text", F.lit("")), WIDTH))


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """last: whether a row is the last of its siblings, those with equal `by`."""
    return rows.withColumn("last", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ix"))) == 1)


def tree(store: DataFrame) -> DataFrame:
    """(doc_id, tree) of a run's store: each cluster with its inconsistent set, axioms, bridges and claims, what claims rest on
    or clash with, and what was set aside. Documents without a statement in a cluster have the latter only."""
    s = store.withColumn("leaf", _leaf())
    inside = s.where("cluster IS NOT NULL")
    roles = F.when(F.col("type") == "axiom", 1).when(F.col("type") == "bridge", 2).otherwise(3)
    items = inside.select("doc_id", "cluster", roles.alias("section"), "pos", "stmt_id", F.col("leaf").alias("label"))
    where = s.select("doc_id", "stmt_id", "pos", "cluster", "leaf")
    sets = conflict_sets(store).select("doc_id", "members", F.explode("members").alias("stmt_id")).join(where, ["doc_id", "stmt_id"]).where("cluster IS NOT NULL")
    items = items.unionByName(sets.select("doc_id", "cluster", F.lit(0).alias("section"), "pos", "stmt_id", F.col("leaf").alias("label")).distinct())
    names = F.element_at(F.array(*map(F.lit, ("minimal inconsistent set", "axioms", "bridge premises", "claims"))), F.col("section") + 1)
    size = items.groupBy("doc_id", "cluster", "section").agg(F.count("*").alias("n"))
    always = inside.select("doc_id", "cluster", F.explode(F.array(F.lit(1), F.lit(3))).alias("section")).distinct()
    sections = always.join(size, ["doc_id", "cluster", "section"], "full").select("doc_id", "cluster", "section", F.coalesce("n", F.lit(0)).alias("n"))
    sections = _numbered(sections.withColumn("ix", F.col("section")), "doc_id", "cluster")
    items = _numbered(items.withColumn("ix", F.struct("pos", "stmt_id")), "doc_id", "cluster", "section")
    claims = inside.where("type NOT IN ('axiom', 'bridge')")
    kids = claims.select("doc_id", "cluster", "stmt_id", "pos", F.posexplode("support").alias("k", "other")).withColumn("way", F.lit("proved from "))
    clash = claims.where("verdict = 'refuted'").select("doc_id", "cluster", "stmt_id", "pos", F.posexplode("conflict").alias("k", "other")).withColumn("way", F.lit("incompatible with "))
    kids = kids.unionByName(clash).join(s.select("doc_id", F.col("stmt_id").alias("other"), "leaf"), ["doc_id", "other"])
    kids = kids.select("doc_id", "cluster", "stmt_id", "pos", F.struct("way", "k").alias("ix"), F.concat("way", "leaf").alias("label"))
    joint = claims.where("verdict = 'contradicts' AND size(conflict) > 0").select("doc_id", "cluster", "stmt_id", "pos", F.struct(F.lit("z").alias("way"), F.lit(0).alias("k")).alias("ix"), F.concat(F.lit("jointly inconsistent with {"), F.array_join("conflict", ", "), F.lit("}")).alias("label"))
    kids = _numbered(kids.unionByName(joint), "doc_id", "cluster", "stmt_id")
    branch = lambda last: F.when(last, "`-- ").otherwise("|-- ")
    trunk = lambda last: F.when(last, "    ").otherwise("|   ")
    key = lambda *at: F.concat(*[F.lpad(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")), 20, "0") for c in at])
    heads = inside.groupBy("doc_id", "cluster").agg(F.min("consistent").alias("ok"))
    heads = heads.select("doc_id", key("cluster").alias("at"), F.concat(F.lit("theory cluster "), F.col("cluster").cast("string"), F.lit("  [axioms consistent: "), F.when(F.col("ok").isNull(), "UNKNOWN").when(F.col("ok"), "YES").otherwise("NO"), F.lit("]")).alias("line"))
    sec = sections.select("doc_id", "cluster", "section", F.col("last").alias("sec_last"), "n")
    ends = heads.join(inside.select("doc_id", key("cluster").alias("at")).distinct(), ["doc_id", "at"]).select("doc_id", F.concat("at", F.lit("~")).alias("at"), F.lit("").alias("line"))
    lines = heads.unionByName(ends).unionByName(sec.select("doc_id", key("cluster", "section").alias("at"), F.concat(branch(F.col("sec_last")), names, F.when(F.col("section") > 0, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise("")).alias("line")))
    placed = items.join(sec, ["doc_id", "cluster", "section"])
    lines = lines.unionByName(placed.select("doc_id", F.concat(key("cluster", "section", "pos"), "stmt_id").alias("at"), F.concat(trunk(F.col("sec_last")), branch(F.col("last")), "label").alias("line")))
    of = placed.where("section = 3").select("doc_id", "cluster", "section", "stmt_id", "sec_last", F.col("last").alias("item_last"))
    under = kids.join(of, ["doc_id", "cluster", "stmt_id"])
    lines = lines.unionByName(under.select("doc_id", F.concat(key("cluster", "section", "pos"), "stmt_id", F.lit(" "), "ix.way", key("ix.k")).alias("at"), F.concat(trunk(F.col("sec_last")), trunk(F.col("item_last")), branch(F.col("last")), "label").alias("line")))
    out = _numbered(s.where("status IN ('quarantined', 'ambiguous')").select("doc_id", "stmt_id", "pos", "status", "text", "reason").withColumn("ix", F.struct("pos", "stmt_id")), "doc_id")
    lines = lines.unionByName(out.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("~").alias("at"), F.concat(F.lit("set aside ("), F.col("n").cast("string"), F.lit(")")).alias("line")))
    lines = lines.unionByName(out.select("doc_id", F.concat(F.lit("~"), key("pos"), "stmt_id").alias("at"), F.concat(branch(F.col("last")), F.lit("["), "stmt_id", F.lit("] "), "status", F.lit(": "), shortened(F.coalesce("text", F.lit("")), WIDTH), F.lit(" :: "), F.coalesce("reason", F.lit(""))).alias("line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("tree"))


def markdown(store: DataFrame, flags: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, report): a report in Markdown of a run's store, the screener's flags (doc_id, a, b, jaccard, signal; a and b are
    statement ids) and tree texts (doc_id, tree). Sections without content are left out, but for the screener's."""
    quoted = lambda c: F.concat(F.lit("“"), F.coalesce(c, F.lit("")), F.lit("”"))
    cell = lambda c: F.coalesce(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("-"))
    docs = store.select("doc_id").distinct()
    s = store.withColumn("outcome", F.coalesce("verdict", "status"))
    at = lambda section, *more: F.struct(F.lit(section).alias("section"), *[(m if isinstance(m, Column) else F.col(m)).cast("string").alias(f"k{i}") for i, m in enumerate([*more, *[F.lit("")] * (3 - len(more))])]).alias("at")
    order = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    rows = docs.select("doc_id", at(0), F.concat(F.lit("# Consistency report\n\nSource: "), "doc_id").alias("line"))

    def section(n: int, title: str, lines: DataFrame, intro: str = "") -> None:
        nonlocal rows
        head = lines.select("doc_id").distinct().select("doc_id", at(n), F.lit(f"\n## {title}\n" + (f"\n{intro}\n" if intro else "")).alias("line"))
        rows = rows.unionByName(head).unionByName(lines)

    counts = s.groupBy("doc_id", "outcome").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("outcome", F.lit(": "), F.col("n").cast("string")))), " | ").alias("line"))
    section(1, "Summary", counts.select("doc_id", at(1, F.lit("a")), "line"))
    table = s.select("doc_id", at(2, F.lit("a"), order("pos"), "stmt_id"), F.concat(F.lit("| "), F.array_join(F.array("stmt_id", "type", "status", F.coalesce("verdict", F.lit("-")), F.coalesce(F.format_number("confidence", 2), F.lit("-")), cell(F.col("text")), F.coalesce(F.concat(F.lit("`"), "fol", F.lit("`")), F.lit("-"))), " | "), F.lit(" |")).alias("line"))
    section(2, "Statements", table, "| id | type | gate | verdict | confidence | statement | formula |\n|---|---|---|---|---|---|---|")
    sets = conflict_sets(store).withColumn("key", F.array_join("members", ", "))
    label = F.concat(F.lit("### {"), "key", F.lit("}"), F.when(F.col("bridged"), " (bridged)").otherwise(" (self-contained)"))
    member = sets.select("doc_id", "key", F.explode("members").alias("stmt_id")).join(s.select("doc_id", "stmt_id", "pos", "type", F.coalesce("original", "text").alias("words"), "span", "fol"), ["doc_id", "stmt_id"])
    where = F.when(F.col("span").isNotNull(), F.format_string(" (characters %d to %d)", "span.start", "span.end")).otherwise("")
    told = member.select("doc_id", at(3, "key", order("pos"), "stmt_id"), F.concat(F.lit("- "), "stmt_id", F.when(F.col("type") == "bridge", " [not stated in the text]").otherwise(""), F.lit(": "), quoted(F.col("words")), where, F.lit(" -> `"), F.coalesce("fol", F.lit("")), F.lit("`")).alias("line"))
    names = member.where("type = 'bridge'").groupBy("doc_id", "key").agg(F.array_join(F.array_sort(F.collect_list("stmt_id")), ", ").alias("b"))
    note = names.select("doc_id", at(3, "key", F.lit("~")), F.concat(F.lit("- Only found if one also accepts "), "b", F.lit("; without it the text's own statements can all be true.")).alias("line"))
    section(3, "Minimal inconsistent sets", sets.select("doc_id", at(3, "key"), F.concat(label, F.lit("\n")).alias("line")).unionByName(told).unionByName(note), "The members of a set cannot all be true; which of them to give up is not decided here.")
    plain = lambda n, verdict, line: s.where(F.col("verdict") == verdict).select("doc_id", at(n, order("pos"), "stmt_id"), F.concat(F.lit("- "), "stmt_id", F.lit(": "), line).alias("line"))
    listed = lambda c, empty: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(empty))
    section(4, "Entailed claims", plain(4, "entailed", F.concat(quoted(F.col("text")), F.lit(" follows from: "), listed("support", "(nothing)"))))
    section(5, "Refuted suppositions", plain(5, "refuted", F.concat(quoted(F.col("text")), F.lit(" contradicts "), listed("conflict", "what is established"))))
    section(6, "Claims that neither follow nor conflict", plain(6, "not_entailed", quoted(F.col("text"))))
    section(7, "Unknown", plain(7, "unknown", quoted(F.col("text"))))
    aside = s.where("status IN ('quarantined', 'ambiguous')").select("doc_id", at(8, order("pos"), "stmt_id"), F.concat(F.lit("- "), "stmt_id", F.lit(" ["), "status", F.lit("]: "), quoted(F.col("text")), F.lit(" :: "), F.coalesce("reason", F.lit(""))).alias("line"))
    section(8, "Set aside", aside)
    shapes = s.where("shape IS NOT NULL").groupBy("doc_id", "shape").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("doc_id")))
    section(9, "Shapes beyond the fragment", shapes.select("doc_id", at(9, F.lpad((F.lit(1 << 40) - F.col("n")).cast("string"), 20, "0"), "shape"), F.format_string("- %s: %d (%s%%)", "shape", "n", F.round(100.0 * F.col("n") / F.col("all")).cast("int").cast("string")).alias("line")))
    found = flags.select("doc_id", at(10, "a", "b"), F.concat(F.lit("- "), "a", F.lit(" and "), "b", F.lit(": "), "signal", F.lit(" (overlap "), F.col("jaccard").cast("string"), F.lit(")")).alias("line"))
    none = docs.join(flags.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", at(10, F.lit("")), F.lit("Nothing flagged.").alias("line"))
    section(10, "Surface screener", found.unionByName(none))
    section(11, "Theory tree", texts.select("doc_id", at(11, F.lit("a")), F.concat(F.lit("```text\n"), "tree", F.lit("\n```")).alias("line")))
    groups = s.where("cluster IS NOT NULL").groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("consistent").alias("ok"), F.max("note").alias("note"))
    section(12, "Clusters", groups.select("doc_id", at(12, order("cluster")), F.concat(F.format_string("- cluster %d: %d statements, consistent: %s", F.col("cluster").cast("int"), "n", F.coalesce(F.col("ok").cast("string"), F.lit("unknown"))), F.coalesce(F.concat(F.lit(" :: "), F.nullif("note", F.lit(""))), F.lit(""))).alias("line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("report"))
