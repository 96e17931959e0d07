"""Formulas as text: tokens, predicates, arities, skeletons and renamings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .morph import const_key, words_of

KEYWORDS = ("forall", "exists", "and", "or", "not")
TOKEN = r"<->|->|[(),.]|[\p{L}_]\w*"
NAME = r"\b(?!(?:forall|exists|and|or|not)\b)([\p{L}_]\w*)\s*\("


def tokens(fol: Column) -> Column:
    return F.regexp_extract_all(fol, F.lit(TOKEN), F.lit(0))


def untokenized(fol: Column) -> Column:
    """What is left of a formula beside tokens and white space; empty if it is well spelled."""
    return F.regexp_replace(F.regexp_replace(fol, TOKEN, ""), r"\s+", "")


def predicates(fol: Column) -> Column:
    """Sorted distinct predicate names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fol, F.lit(NAME), F.lit(1))))


def atoms(fol: Column) -> Column:
    """array<struct(pred, arity)> in reading order."""
    found = F.regexp_extract_all(fol, F.lit(NAME + r"[^()]*\)"), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"^(\w+)", 1).alias("pred"), F.size(F.split(a, ",")).alias("arity")))


def names(fol: Column) -> Column:
    """The predicates of atoms()."""
    found = F.regexp_extract_all(fol, F.lit(NAME + r"[^()]*\)"), F.lit(0))
    return F.transform(found, lambda a: F.regexp_extract(a, r"^(\w+)", 1))


def max_arity(fol: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(atoms(fol), lambda a: a["arity"])), F.lit(0))


def skeleton(fol: Column) -> Column:
    """The formula with each predicate name replaced by <P>, without white space."""
    return F.regexp_replace(F.regexp_replace(fol, NAME, "<P>("), r"\s+", "")


def modifier_variant(a: Column, b: Column) -> Column:
    """Whether the words of one predicate name are among the other's."""
    wa, wb = words_of(a), words_of(b)
    return (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)


def modifier_only(a: Column, b: Column) -> Column:
    """Whether two formulas differ in nothing but modifiers of their predicates."""
    pa, pb = (F.transform(atoms(f), lambda x: x["pred"]) for f in (a, b))
    pairs = F.arrays_zip(pa.alias("a"), pb.alias("b"))
    same = F.forall(pairs, lambda p: (p["a"] == p["b"]) | modifier_variant(p["a"], p["b"]))
    return (skeleton(a) == skeleton(b)) & same


def renamed(fol: Column, names: Column) -> Column:
    """All names replaced at once by a map<string,string>; a null map leaves the formula."""
    parts = F.regexp_extract_all(fol, F.lit(r"\w+|\W+"), F.lit(0))
    return F.when(names.isNull(), fol).otherwise(F.array_join(F.transform(parts, lambda t: F.coalesce(F.element_at(names, t), t)), ""))


def swapped(fol: Column, preds: Column) -> Column:
    """Arguments of two-place atoms turned round for the predicates of an array<string>."""
    turn = lambda f, p: F.regexp_replace(f, F.concat(F.lit(r"\b"), p, F.lit(r"\(\s*(\w+)\s*,\s*(\w+)\s*\)")), F.concat(p, F.lit("($2, $1)")))
    return F.aggregate(F.coalesce(preds, F.array().cast("array<string>")), fol, turn)


def canonical(fol: Column, names: Column) -> Column:
    """Predicates replaced by a map<string,string>, constants by their keys; bound variables and spacing stay."""
    heads = F.regexp_extract_all(fol, F.lit(r"\b(?:forall|exists)\s+([\w\s,]+?)\s*\."), F.lit(1))
    bound = F.flatten(F.transform(heads, lambda h: F.split(h, r"\s*,\s*")))
    parts = F.regexp_extract_all(fol, F.lit(r"(?U)\w+\s*\(|\w+|\W+"), F.lit(0))
    pred = lambda t: F.regexp_extract(t, r"(?U)^(\w+)\s*\($", 1)
    is_pred = lambda t: (pred(t) != "") & ~pred(t).isin(*KEYWORDS)
    is_const = lambda t: F.rlike(t, F.lit(r"(?U)^\w+$")) & ~t.isin(*KEYWORDS) & ~F.array_contains(bound, t)
    new = lambda t: F.when(is_pred(t), F.concat(F.coalesce(F.element_at(names, pred(t)), pred(t)), F.lit("("))).when(is_const(t), const_key(t)).otherwise(t)
    return F.array_join(F.transform(parts, new), "")
