"""One run over a corpus of statements: candidate formulas, gate, bridges, unified names, duplicates, screener, verdicts.

Every stage is a plan over all documents; what a stage reads twice is written once, by a checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.formulas import atoms, canonical, names, predicates
from ..functions.formulas import renamed as reworded
from ..functions.morph import pred_key
from ..logic import fol as logic
from . import admission, forms, shapes, translate, verdict, vocab
from .runtime import cut

#: Bridges come after all statements of their document.
AFTER = 1 << 40
BRIDGED = 1.0
#: Candidates of a statement in the order in which they show their names.
SIDES = ("rule", "other")


def _alpha(formula: pd.Series) -> pd.Series:
    return formula.map(logic.alpha_key)


def _renamings(named: DataFrame) -> DataFrame:
    """(doc_id, name, new) of (doc_id, pos, name): each predicate as its document first showed its key, negations of one seen before
    as `not` and that."""
    seen = vocab.first_seen(named)
    shown = seen.select("doc_id", "key", "display")
    denied = vocab.negation_map(seen).join(shown.select("doc_id", F.col("key").alias("base"), F.col("display").alias("positive")), ["doc_id", "base"])
    shown = shown.join(denied.select("doc_id", "key", F.concat(F.lit("not "), "positive").alias("denial")), ["doc_id", "key"], "left")
    shown = shown.select("doc_id", "key", F.coalesce("denial", "display").alias("new"))
    keys = named.select("name").distinct().select("name", pred_key(F.col("name")).alias("key"))
    return named.select("doc_id", "name").distinct().join(keys, "name").join(shown, ["doc_id", "key"]).select("doc_id", "name", "new")


def _canonical(rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """rows (*cols, said_*, new), cols in canonical() by the map new, each formula once for what its names become. said_* are the
    names of cols."""
    used = {c: F.array_join(F.transform(f"said_{c}", lambda n: F.coalesce(F.element_at("new", n), n)), ",") for c in cols}
    rows = rows.withColumns({f"used_{c}": x for c, x in used.items()})
    both = rows.select(F.explode(F.array(*[F.struct(F.col(c).alias("form"), F.coalesce(f"used_{c}", F.lit("")).alias("used")) for c in cols])).alias("x")).select("x.*").where("form IS NOT NULL")
    found = forms.distinct(both)
    if found is None:
        rows = rows.withColumns({c: canonical(F.col(c), F.col("new")) for c in cols})
    else:
        pairs = F.array_distinct(F.arrays_zip(names(F.col("form")).alias("old"), F.split("used", ",").alias("new")))
        done = cut(found.select("form", "used", canonical(F.col("form"), F.when(F.col("used") != "", F.map_from_entries(pairs))).alias("out")))
        for c in cols:
            mine = done.select(F.col("form").alias(c), F.col("used").alias(f"used_{c}"), F.col("out").alias(f"out_{c}"))
            rows = forms.met(rows, mine, [c, f"used_{c}"], [f"out_{c}"])
        rows = rows.withColumns({c: F.col(f"out_{c}") for c in cols}).drop(*[f"out_{c}" for c in cols])
    return rows.drop("new", *[f"{x}_{c}" for c in cols for x in ("said", "used")])


def _named(rows: DataFrame, ids: tuple[str, ...], cols: tuple[str, ...]) -> DataFrame:
    """(doc_id, *ids, name, at): the predicates of rows and where in the document they stand."""
    each = F.flatten(F.array(*[F.coalesce(f"said_{c}", F.array().cast("array<string>")) for c in cols]))
    return rows.select("doc_id", *ids, "pos", F.posexplode(F.array_distinct(each)).alias("k", "name")).select("doc_id", *ids, "name", F.struct("pos", *ids, "k").alias("at"))


def normalised(formulas: DataFrame, *ids: str, cols: tuple[str, ...] = ("fol",)) -> DataFrame:
    """Formulas (doc_id, *ids, pos, *cols) with each predicate as its document first showed its key, negations of one seen before
    as `not` and that, and constants as their keys. The columns ids tell the rows of a document apart; of a row's formulas,
    those of the earlier column show their names first.

    Documents with the same names in the same order are named alike and once; those of more than shapes.MOST names by joins.
    Columns said_*, the names() of cols, are made where they are not there."""
    formulas = formulas.withColumns({f"said_{c}": names(F.col(c)) for c in cols if f"said_{c}" not in formulas.columns})
    first = _named(formulas, ids, cols).groupBy("doc_id", "name").agg(F.min("at").alias("at"))
    order = F.sort_array(F.collect_list(F.struct("k", "name")))
    docs = shapes.first_rows(first.where("doc_id IS NOT NULL"), shapes.MOST, "at").groupBy("doc_id").agg(F.transform(order, lambda x: x["name"]).alias("names"))
    docs = cut(docs.select("doc_id", "names", F.sha2(F.array_join("names", " "), 256).alias("shape"), (F.size("names") > shapes.MOST).alias("many")))
    large = docs.where("many").select("doc_id")
    docs = docs.where("NOT many")
    kinds = cut(docs.groupBy("shape").agg(F.count("*").alias("n"), F.max("names").alias("names")))
    new = _renamings(kinds.select(F.col("shape").alias("doc_id"), F.posexplode("names").alias("pos", "name")))
    new = new.groupBy(F.col("doc_id").alias("shape")).agg(F.map_from_entries(F.collect_list(F.struct("name", "new"))).alias("new"))
    new = shapes.matched(docs.select("doc_id", "shape"), kinds.select("shape", "n"), cut(new.join(kinds.select("shape", "n"), "shape"))).select("doc_id", "new")
    if large.isEmpty():
        return _canonical(formulas.join(new, "doc_id", "left"), cols)
    # A document of many names: each row gets the map of its own names alone.
    some = formulas.join(large, "doc_id", "left_semi")
    named = _named(some, ids, cols)
    used = _renamings(named.select("doc_id", F.col("at").alias("pos"), "name"))
    maps = named.select("doc_id", *ids, "name").join(used, ["doc_id", "name"]).groupBy("doc_id", *ids).agg(F.map_from_entries(F.collect_list(F.struct("name", "new"))).alias("new"))
    rest = formulas.join(large, "doc_id", "left_anti").join(new, "doc_id", "left")
    return _canonical(rest.unionByName(some.join(maps, ["doc_id", *ids], "left")), cols)


def unified(formulas: DataFrame, self_ref: bool = False) -> DataFrame:
    """Formulas (doc_id, stmt_id, fol[, n]) after the aliases of their document (modified heads, with self_ref names of the author,
    then relations) and without loose guards: doc_id, stmt_id, fol, stripped. n: how many statements have the formula."""
    many = ["n"] if "n" in formulas.columns else []
    f = formulas.select("doc_id", "stmt_id", "fol", *many)
    each = f.select("doc_id", "stmt_id", F.explode(atoms(F.col("fol"))).alias("a"))
    aliases = vocab.modifier_aliases(each.select("doc_id", F.col("a.pred").alias("name")).distinct())
    if self_ref:
        consts = f.select("doc_id", F.explode(admission.constants(F.col("fol"))).alias("const")).distinct()
        aliases = aliases.unionByName(vocab.self_aliases(consts))
    f = cut(vocab.apply_aliases(f, aliases.withColumn("swap", F.lit(False))))
    each = f.select("doc_id", "stmt_id", *many, F.explode(atoms(F.col("fol"))).alias("a"))
    relations = vocab.relation_aliases(each.select("doc_id", "stmt_id", *many, "a.pred", "a.arity"))
    return vocab.strip_guards(cut(vocab.apply_aliases(f, relations)))


def candidates(statements: DataFrame, guard_deontic: bool = False) -> DataFrame:
    """Statements (doc_id, stmt_id, pos, type, text, other) with rule, the formula by rules alone, and both candidates
    normalised over their document. Statements that a guard sets aside have no candidates, so that their names are not seen;
    a statement's own formula shows its names before the translator's.

    Rows are read with nines for their number (forms), a column, where the text has no other and the candidates' constants, by
    their keys, have it alone; the number is null for the rest, which are as they stand."""
    texts = [c for c in ("text", "original") if c in statements.columns]
    options = [c for c in ("type", "guard_deontic") if c in statements.columns]
    s = statements.withColumn("number", forms.number(*[F.col(c) for c in texts]))
    s = s.withColumns({c: F.when(F.col("number").isNotNull(), forms.masked(F.col(c))).otherwise(F.col(c)) for c in texts})
    s = s.withColumn("as_other", forms.masked(F.col("other")))
    keyed = lambda f: canonical(f, F.lit(None).cast("map<string,string>"))
    digit = F.lit(r"\d\w*\s*\(")

    def shown(rows: DataFrame, c: str, f: Column) -> DataFrame:
        """Adds the candidate by the keys of its constants, its names, whether a digit is in one, and its one run of digits: empty if
        there is none, null if there are several."""
        rows = rows.withColumns({f"key_{c}": keyed(f), f"said_{c}": names(f), f"odd_{c}": F.coalesce(F.rlike(f, digit), F.lit(False))})
        return rows.withColumn(f"run_{c}", F.when(f.isNull(), "").otherwise(forms.number(F.col(f"key_{c}"))))

    def read(rows: DataFrame) -> DataFrame:
        found = admission.guarded(rows, guard_deontic)
        found = found.withColumn("rule", F.when(F.col("guard").isNull(), translate.formula(F.col("text"))))
        return shown(shown(found, "rule", F.col("rule")), "other", F.col("as_other"))

    s = forms.by_form(s, [*texts, *options, "as_other"], read)
    number, nines = F.col("number"), forms.masked(F.col("number"))
    own = F.regexp_replace("other", "[^0-9]", "")
    fits = ~F.col("odd_rule") & ~F.col("odd_other") & ((F.col("run_rule") == "") | (F.col("run_rule") == nines))
    fits = fits & ((F.col("run_other") == "") | ((F.col("run_other") == nines) & ((own == number) | (forms.number(F.col("other")) == number))))
    s = s.withColumn("fits", F.coalesce(fits, F.lit(False)))
    told = lambda c: forms.told(F.col(c), number)
    said = {"said_rule": F.when(F.col("odd_rule"), names(told("rule"))).otherwise(F.col("said_rule")), "said_other": F.when(F.col("odd_other"), names(F.col("other"))).otherwise(F.col("said_other"))}
    free = lambda c: F.when(F.col("guard").isNull(), c)
    s = s.withColumns(
        {c: F.when(F.col("fits"), F.col(c)).otherwise(told(c)) for c in texts}
        | {"rule": F.when(F.col("fits"), F.col("key_rule")).otherwise(told("rule")), "other": free(F.when(F.col("fits"), F.col("key_other")).otherwise(F.col("other")))}
        | {"said_rule": said["said_rule"], "said_other": free(said["said_other"]), "number": F.when(F.col("fits"), number)}
    )
    return normalised(cut(s.drop("guard", "fits", "as_other", *[f"{x}_{c}" for x in ("key", "run", "odd") for c in SIDES])), "stmt_id", cols=SIDES)


def judged(formulas: DataFrame, self_ref: bool = False, effort: int = 1) -> DataFrame:
    """What is found on accepted formulas (doc_id, stmt_id, pos, type, fol), one row for equal ones of a type and each bridge:
    doc_id, type, raw (the formula), own (a bridge's stmt_id, else empty), head (the first statement), fol (unified), first
    (an earlier statement of the same formula), verdict, support, conflict, note, cluster, consistent.

    Documents that are equal up to the names of their constants are worked out once. Statements of a formula stand for one, with
    their number, which tells the relations' names."""
    own = F.when(F.col("type") == "bridge", F.col("stmt_id")).otherwise("")
    found = formulas.where("doc_id IS NOT NULL").groupBy("doc_id", "type", F.col("fol").alias("raw"), own.alias("own")).agg(F.min(F.struct("pos", "stmt_id")).alias("h"), F.count("*").alias("n"))
    part = W.partitionBy("doc_id")
    c = found.select("doc_id", "type", "raw", "own", F.col("h.stmt_id").alias("head"), F.col("h.pos").alias("at"), F.when(F.contains("raw", F.lit(",")), F.col("n")).otherwise(F.lit(1)).cast("long").alias("n"))
    c = c.withColumn("pos", F.row_number().over(part.orderBy("at", "head"))).withColumn("rank", F.row_number().over(part.orderBy("head")))
    c = c.withColumn("ranked", (F.count("*").over(part) <= shapes.MOST) & F.bool_and(F.rlike("head", F.lit(r"\A[A-Za-z0-9_.\-]+\z"))).over(part))
    ids = F.collect_list(F.when(F.col("ranked"), F.col("head"))).over(part.orderBy("head").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # Verdicts hang on the order of ids, not on what they are.
    c = cut(c.withColumn("ids", ids).withColumn("stmt_id", F.when(F.col("ranked"), F.lpad(F.col("rank").cast("string"), 4, "0")).otherwise(F.col("head"))))
    rows = c.select("doc_id", "pos", "stmt_id", "type", "n", F.col("raw").alias("fol"))
    preds = F.flatten(F.transform("s", lambda r: F.coalesce(predicates(r["t"]), F.array().cast("array<string>"))))
    good = ~F.arrays_overlap("names", preds)
    if self_ref:
        good = good & ~F.arrays_overlap("names", F.array(*map(F.lit, vocab.SELF)))
    docs = shapes.of_formulas(rows, "stmt_id", "type", "n", good=F.coalesce(good, F.lit(True)))

    def work(some: DataFrame) -> DataFrame:
        p = cut(rows.join(some, "doc_id", "left_semi"))
        u = cut(unified(p, self_ref).withColumn("alpha", F.pandas_udf(_alpha, T.StringType())(F.col("fol"))).select("doc_id", "stmt_id", "fol", "alpha"))
        p = p.withColumnRenamed("fol", "was").join(u, ["doc_id", "stmt_id"])
        p = cut(p.join(verdict.duplicates(p), ["doc_id", "stmt_id"], "left").drop("alpha", "n"))
        return p.join(verdict.verified(p.where("first IS NULL"), effort), ["doc_id", "stmt_id"], "left").drop("stmt_id", "type")

    out = c.drop("n", "at", "rank", "stmt_id").join(shapes.spread(docs, work), ["doc_id", "pos"])
    # A result's ids and constants are those of the document that was worked out.
    real = lambda i: F.when(F.col("ranked"), F.get("ids", i.cast("int") - 1)).otherwise(i)
    term = F.when(F.col("names").isNull() | (F.col("fol") == F.col("was")), F.when(F.col("fol") == F.col("was"), F.col("raw")).otherwise(F.col("fol")))
    fol = term.otherwise(reworded(F.col("fol"), F.map_from_arrays("rep_names", "names")))
    return out.select("doc_id", "type", "raw", "own", "head", fol.alias("fol"), real(F.col("first")).alias("first"), "verdict", F.transform("support", real).alias("support"), F.transform("conflict", real).alias("conflict"), "note", "cluster", "consistent")


def run(statements: DataFrame, bridges: DataFrame | None = None, guard_deontic: bool = False, allow_relations: bool = False, self_ref: bool = False, effort: int = 1) -> DataFrame:
    """The store of a run over statements (doc_id, stmt_id, pos, type, text, other[, original]) and bridges (doc_id, stmt_id,
    fol, gloss): doc_id and stmt_id (strings), pos, type, text, status, confidence, reason, shape, fol, first (the earlier
    statement of the same formula, else null), verdict, support, conflict, note, cluster, consistent.

    Columns guard_deontic and allow_relations of statements hold for their rows instead of the arguments, so that documents with
    options of their own are one plan. other is a translator's formula, null where there is none. stmt_id is unique within a document. Duplicates take no part in
    verdicts. A bridge that does not parse is quarantined. No statements give no rows."""
    ids = [F.col(c).cast("string").alias(c) for c in ("doc_id", "stmt_id")]
    extra = [c for c in ("original", "guard_deontic", "allow_relations") if c in statements.columns]
    s = statements.select(*ids, F.col("pos").cast("long").alias("pos"), "type", "text", "other", *extra)
    store = admission.decisions(cut(candidates(s, guard_deontic)), guard_deontic, allow_relations)
    if bridges is not None:
        good = admission.valid(F.col("fol"))
        b = bridges.select(*ids, F.col("fol").alias("raw"), good.alias("fol"), "gloss").withColumn("pos", AFTER + F.row_number().over(W.partitionBy("doc_id").orderBy("stmt_id")))
        ok = F.col("fol").isNotNull()
        b = b.select(
            "doc_id", "stmt_id", "pos", F.lit("bridge").alias("type"), F.coalesce("gloss", "raw").alias("text"), F.when(ok, "accepted").otherwise("quarantined").alias("status"),
            F.when(ok, BRIDGED).alias("confidence"), F.when(ok, "bridge").otherwise("no formula").alias("reason"), F.lit(None).cast("string").alias("shape"), "fol",
        )
        store = store.unionByName(b)
    store = cut(store)
    f = store.where("fol IS NOT NULL").select("doc_id", "stmt_id", "pos", "type", "fol")
    if bridges is not None:
        f = cut(normalised(f, "stmt_id"))
        store = store.drop("fol").join(f.select("doc_id", "stmt_id", "fol"), ["doc_id", "stmt_id"], "left")
    v = judged(f, self_ref, effort).withColumnRenamed("fol", "final").withColumnRenamed("first", "earlier")
    store = store.withColumn("own", F.when(F.col("type") == "bridge", F.col("stmt_id")).otherwise("")).withColumnRenamed("fol", "raw")
    met = store.join(v, ["doc_id", "type", "raw", "own"], "left")
    head = F.col("stmt_id") == F.col("head")
    first = F.coalesce("earlier", F.when(~head, F.col("head")))
    mine = [F.when(head, F.col(c)).alias(c) for c in ("verdict", "support", "conflict", "note", "cluster", "consistent")]
    return met.select("doc_id", "stmt_id", "pos", "type", "text", "status", "confidence", "reason", "shape", F.col("final").alias("fol"), first.alias("first"), *mine)
