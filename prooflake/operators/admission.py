"""Admission of statements with two candidate formulas: lexical fidelity and the gate's decision, as Column expressions.
Only parsing, the scope test and equivalence, which need the parser and the solver, run in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.cues import deontic_cue, hedge_cue, quarantine_shape
from ..functions.formulas import KEYWORDS, NAME, atoms, max_arity, modifier_only, predicates
from ..functions.morph import NEGATIVE_PREFIXES, NUMBER_WORDS, lemma, words_of
from ..functions.numbers import rounded
from ..functions.text import word_matches
from ..logic import fol as logic
from ..logic import sat
from . import forms
from .relational import EXCLUDED
from .runtime import cut
from .translate import let

# Words without content, determiners glued to the front of constants, and confidences.
CONTENTLESS = ("a", "an", "the", "of", "is", "are", "be", "to", "in", "on", "at", "by", "for", "with", "that", "this", "these", "those", "it", "its", "their", "his", "her", "has", "have", "had", "was", "were", "and", "or", "as", "from", "into", "they", "them", "some", "every", "all", "any", "no")
DETERMINERS = ("the", "this", "that", "her", "his", "their", "an", "a")
AGREED, SINGLE_RULE, DIVERGED, SINGLE_OTHER = 0.95, 0.8, 0.75, 0.7
THRESHOLD, RELAXED = 0.6, 0.5


def _content(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*CONTENTLESS) & ~F.rlike(w, F.lit(r"^\d*$")) & (F.length(w) >= 2))


def _constant_words(name: Column) -> Column:
    """Words of a constant, a determiner at the front of each piece taken off if three letters remain."""
    pieces = F.filter(F.split(F.lower(name), r"[_\s]+"), lambda p: p != "")
    return _content(F.transform(pieces, lambda p: F.when(p == "thisdocument", "document").otherwise(F.regexp_replace(p, f"^(?:{'|'.join(DETERMINERS)})(?=.{{3}})", ""))))


def _signatures(name: Column) -> Column:
    """Spellings that a code-like constant may have in a text without punctuation."""
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    head = F.regexp_extract(bare, r"^([a-z]+)\d", 1)
    digit = F.element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), F.when(head.isin(*NUMBER_WORDS), head))
    spelled = F.concat(digit, F.substr(bare, F.length(head) + 1))
    return F.filter(F.array(bare, F.regexp_replace(bare, r"^[a-z](?=\d)", ""), F.coalesce(spelled, bare)), lambda s: F.length(s) >= 2)


def constants(formula: Column) -> Column:
    """Names in reading order that are neither predicates, keywords nor variables of a quantifier."""
    heads = F.regexp_extract_all(formula, F.lit(r"\b(?:forall|exists)\s+([\w\s,]+?)\s*\."), F.lit(1))
    bound = F.flatten(F.transform(heads, lambda h: F.split(h, r"\s*,\s*")))
    body = F.regexp_replace(formula, r"\b(?:forall|exists)\s+[\w\s,]+?\s*\.", " ")
    names = F.regexp_extract_all(F.regexp_replace(body, NAME, "("), F.lit(r"\b[A-Za-z_]\w*\b"), F.lit(0))
    return F.filter(names, lambda n: ~n.isin(*KEYWORDS) & ~F.array_contains(bound, n))


def _stripped(words: Column, prefix: str) -> Column:
    """Words without the prefix, of those that have it before at least three letters."""
    have = F.filter(words, lambda w: w.startswith(prefix) & (F.length(w) >= len(prefix) + 3))
    return F.transform(have, lambda w: F.substr(w, F.lit(len(prefix) + 1)))


def stems(text: Column) -> Column:
    """Words of a text, their lemmas, and both without negative prefixes."""
    said = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    both = F.array_distinct(F.concat(said, F.transform(said, lemma)))
    return let(both, lambda ws: F.concat(ws, *[_stripped(ws, p) for p in NEGATIVE_PREFIXES]))


def fidelity(formula: Column, text: Column, known: Column, said: Column | None = None) -> Column:
    """struct(coverage, passed, could): which share of a formula's content words its text mentions. Predicates in known count as
    mentioned; a constant like a code counts once. One predicate word that is mentioned lowers the threshold. A formula without
    content words is covered; a null formula gives null. could: whether it would pass if all its predicates were known. said: the
    text's stems, where they are there already."""
    run = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")

    def judge(ls: Column) -> Column:
        of_pred = lambda a: F.transform(_content(words_of(a["pred"])), lambda w: F.struct(w.alias("w"), word_matches(w, ls).alias("hit"), F.array_contains(known, a["pred"]).alias("known")))
        found = F.flatten(F.transform(atoms(formula), of_pred))
        code = lambda c: F.rlike(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(r"^[a-z]{0,3}\d[\da-z]*$"))
        of_const = lambda c: F.when(code(c), F.array(F.exists(_signatures(c), lambda s: F.contains(run, s)))).otherwise(F.transform(_constant_words(c), lambda w: word_matches(w, ls)))
        of_all = lambda preds: let(F.flatten(F.transform(constants(formula), of_const)), lambda cs: F.struct(F.concat(F.transform(preds, lambda p: p["hit"] | p["known"]), cs).alias("now"), F.concat(F.transform(preds, lambda p: F.lit(True)), cs).alias("most")))
        lone = lambda preds: (F.size(preds) > 0) & (F.size(F.array_distinct(F.transform(preds, lambda p: p["w"]))) == 1) & F.forall(preds, lambda p: p["hit"])
        share = lambda hits: F.when(F.size(hits) > 0, F.size(F.filter(hits, lambda h: h)) / F.size(hits)).otherwise(1.0)
        both = lambda preds: let(of_all(preds), lambda h: F.struct(share(h["now"]).alias("now"), share(h["most"]).alias("most"), F.when(lone(preds), RELAXED).otherwise(THRESHOLD).alias("least")))
        score = lambda preds: let(both(preds), lambda x: F.struct(rounded(x["now"], 3).alias("coverage"), (x["now"] >= x["least"]).alias("passed"), (x["most"] >= x["least"]).alias("could")))
        return let(found, score)

    return F.when(formula.isNotNull(), let(stems(text) if said is None else said, judge))


def _valid(formula: pd.Series) -> pd.Series:
    return formula.map(lambda f: f if f and logic.error(f) is None else None)


def _safe(formula: pd.Series) -> pd.Series:
    return formula.map(lambda f: bool(f) and logic.epr_safe(f))


@lru_cache(maxsize=16384)
def _equivalent(a: str, b: str) -> bool:
    return sat.equivalent(a, b) == "equivalent"


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x) and bool(y) and (x == y or _equivalent(x, y)) for x, y in zip(a, b)], dtype=bool)


valid = lambda c: F.pandas_udf(_valid, T.StringType())(c)
safe = lambda c: F.pandas_udf(_safe, T.BooleanType())(c)
same = lambda a, b: F.pandas_udf(_same, T.BooleanType())(a, b)


def option(statements: DataFrame, name: str, default: bool) -> Column:
    """An option of a statement: the column of that name, where there is one and it isn't null, else the default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in statements.columns else F.lit(default)


def guarded(statements: DataFrame, guard_deontic: bool = False) -> DataFrame:
    """Adds guard: why a statement is set aside before any candidate is looked at (type, hedged, norm), else null."""
    strict = option(statements, "guard_deontic", guard_deontic)
    texts = [F.col(c) for c in ("text", "original") if c in statements.columns]
    guard = F.when(F.col("type").isin(*EXCLUDED), "type").when(hedge_cue(*texts).isNotNull(), "hedged")
    return statements.withColumn("guard", guard.when(strict & deontic_cue(*texts).isNotNull(), "norm"))


#: What decided() adds.
DECIDED = ("guard", "rule_ok", "other_ok", "status", "confidence", "reason", "shape", "side", "settled")


def screened(statements: DataFrame, guard_deontic: bool = False, allow_relations: bool = False) -> DataFrame:
    """Adds guard, rule_ok and other_ok, whether the candidates parse and may be told of, and none, whether neither parses."""
    wide = option(statements, "allow_relations", allow_relations)
    s = guarded(statements, guard_deontic)
    for c in ("rule", "other"):
        s = s.withColumn(f"{c}_ok", valid(F.col(c)).isNotNull())
    s = s.withColumn("none", ~F.col("rule_ok") & ~F.col("other_ok"))
    if allow_relations or "allow_relations" in statements.columns:
        for c in ("rule", "other"):
            s = s.withColumn(f"{c}_ok", F.col(f"{c}_ok") & (~wide | (max_arity(F.col(c)) < 2) | safe(F.col(c))))
    return s


def _known(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, known): predicates of a statement of screened() that an earlier one of its document has."""
    names = F.array_union(*[F.coalesce(predicates(F.when(F.col(f"{c}_ok"), F.col(c))), F.array().cast("array<string>")) for c in ("rule", "other")])
    used = rows.where("guard IS NULL").select("doc_id", "pos", F.explode(names).alias("pred"))
    earlier = used.withColumn("earlier", F.min("pos").over(W.partitionBy("doc_id", "pred")) < F.col("pos")).where("earlier")
    return earlier.groupBy("doc_id", "pos").agg(F.collect_set("pred").alias("known"))


def decided(s: DataFrame, known: Column, allow_relations: bool = False) -> DataFrame:
    """Adds the rest of DECIDED to rows of screened(); known has the predicates that count as mentioned. side: which candidate is
    kept; settled: whether the decision is the same whatever is known."""
    wide, known = option(s, "allow_relations", allow_relations), F.coalesce(known, F.array().cast("array<string>"))
    rule, other = (F.when(F.col(f"{c}_ok"), F.col(c)) for c in ("rule", "other"))
    s = s.withColumn("same", same(rule, other)).withColumn("said", F.when(F.col("guard").isNull() & ~F.col("none"), stems(F.col("text"))))
    judged = lambda c: fidelity(F.when(F.col("guard").isNull(), c), F.col("text"), known, F.col("said"))
    s = s.withColumn("a", judged(rule)).withColumn("b", judged(other))
    a, b = F.coalesce("a.passed", F.lit(False)), F.coalesce("b.passed", F.lit(False))
    two, one = rule.isNotNull() & other.isNotNull(), F.coalesce(rule, other)
    more = max_arity(rule) - max_arity(other)
    case = F.when(F.col("guard").isNotNull(), F.col("guard")).when(F.col("none"), "no formula").when(one.isNull(), "relational role")
    case = case.when(wide & two & (more != 0), "greater arity")
    case = case.when(two & F.col("same"), "agreed").when(two & (a != b), "one faithful").when(two & a & modifier_only(rule, other), "modifier only")
    case = case.when(two & a, "ambiguous").when(two, "none faithful").when(a, "rule faithful").when(b, "other faithful").otherwise("not faithful")
    s = s.withColumn("reason", case)
    r = F.col("reason")
    confidence = F.when(r == "agreed", AGREED).when(r.isin("greater arity", "one faithful", "modifier only"), DIVERGED).when(r == "rule faithful", SINGLE_RULE).when(r == "other faithful", SINGLE_OTHER)
    first = F.when(r == "greater arity", more > 0).when(r == "one faithful", a).when(confidence.isNotNull(), rule.isNotNull())
    status = F.when(confidence.isNotNull(), "accepted").when(r == "ambiguous", "ambiguous").otherwise("quarantined")
    shape = F.when(r.isin("no formula", "not faithful"), quarantine_shape(F.col("text"))).when(r == "relational role", "relational-role(∀∃)")
    apart = [F.coalesce(F.col(f"{x}.passed") == F.col(f"{x}.could"), F.lit(True)) for x in "ab"]
    s = s.withColumns({"status": status, "confidence": confidence, "shape": shape, "side": F.when(first, "rule").when(~first, "other"), "settled": r.isin("greater arity", "agreed") | (apart[0] & apart[1])})
    return s.drop("none", "same", "said", "a", "b")


def _decision(s: DataFrame) -> DataFrame:
    kept = F.when(F.col("side") == "rule", F.col("rule")).when(F.col("side") == "other", F.col("other"))
    told = lambda c: forms.told(c, F.col("number"))
    return s.select("doc_id", "stmt_id", "pos", "type", told(F.col("text")).alias("text"), "status", "confidence", "reason", "shape", told(kept).alias("fol"))


def gate(statements: DataFrame, guard_deontic: bool = False, allow_relations: bool = False) -> DataFrame:
    """Decision on (doc_id, stmt_id, pos, type, text, rule, other): status, confidence, reason, shape, fol. Where there is a
    column original, the statement in its author's words, hedges and norms are looked for there too.

    rule and other are candidate formulas, null where there is none; what doesn't parse is as good as none. With
    allow_relations, candidates beyond the decidable fragment go and the one of greater arity wins. Ambiguous statements have
    no fol. A predicate of an earlier statement of the document counts as mentioned. Equivalence left open counts as
    divergence. Columns guard_deontic and allow_relations, where there are any, hold for their rows instead of the arguments.

    Statements are decided by their forms, once for what are equal up to their number. Earlier statements are looked at only
    for those whose decision hangs on them.
    """
    texts = [c for c in ("text", "original", "rule", "other") if c in statements.columns]
    s = statements.withColumn("number", forms.number(*[F.col(c) for c in texts]))
    return decisions(s.withColumns({c: F.when(F.col("number").isNotNull(), forms.masked(F.col(c))).otherwise(F.col(c)) for c in texts}), guard_deontic, allow_relations)


def decisions(statements: DataFrame, guard_deontic: bool = False, allow_relations: bool = False) -> DataFrame:
    """gate() of statements whose texts and candidates are read with nines for their number, a column; where it is null, they are
    as they stand."""
    cols = [c for c in ("text", "original", "rule", "other", "type", "guard_deontic", "allow_relations") if c in statements.columns]
    read = lambda rows: screened(rows, guard_deontic, allow_relations)
    kinds = forms.distinct(statements.select(*cols))
    if kinds is None:
        s = read(statements)
        return _decision(decided(s.join(_known(s), ["doc_id", "pos"], "left"), F.col("known"), allow_relations))
    done = cut(decided(read(kinds), F.lit(None).cast("array<string>"), allow_relations))
    s = forms.met(statements, done, cols, list(DECIDED))
    if done.where("NOT settled").isEmpty():
        return _decision(s)
    s = cut(s)
    # Names are compared as they stand, and read with nines again.
    told = s.withColumns({c: forms.told(F.col(c), F.col("number")) for c in ("rule", "other")})
    left = s.where("NOT settled")
    said = F.array_union(*[F.coalesce(predicates(forms.told(F.col(c), F.col("number"))), F.array().cast("array<string>")) for c in ("rule", "other")])
    mine = F.array_join(F.array_sort(F.array_intersect("known", said)), " ")
    left = left.drop(*DECIDED).join(_known(told.join(left.select("doc_id").distinct(), "doc_id", "left_semi")), ["doc_id", "pos"], "left")
    left = left.withColumn("known", F.when(F.col("number").isNotNull(), forms.masked(mine)).otherwise(mine))
    again = forms.by_form(left, [*cols, "known"], lambda rows: decided(read(rows), F.split(F.nullif("known", F.lit("")), " "), allow_relations))
    return _decision(s.where("settled")).unionByName(_decision(again))
