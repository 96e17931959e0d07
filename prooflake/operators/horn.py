"""Forward chaining over relations of any arity, with provenance: saturation, refutations and their proofs.

Formulas are parsed once, in Arrow batches, into rules that carry their own join orders; everything after that is joins.
A round starts from the literals of the round before, matches them with one body atom, and meets the other atoms one
by one on document, predicate and the argument places bound so far, so that a join never pairs what can't unify.
"""

from __future__ import annotations

from itertools import count

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logic import fol
from . import shapes
from .runtime import cut

ATOM = "struct<at:int,pred:string,args:array<string>,mask:array<int>>"
RULES = f"doc_id string, stmt_id string, pos long, head struct<neg:boolean,pred:string,args:array<string>>, steps array<array<{ATOM}>>, names array<string>"
#: Holds of every constant of a document; gives values to variables that no body atom binds.
DOMAIN = "$of"


def orders(body: list[tuple[str, tuple]]) -> list[list[dict]]:
    """For each atom of a body the order in which the atoms are met when that one comes first: next is the atom with most
    arguments bound, then the leftmost. mask: the bound places."""
    out = []
    for first in range(len(body)):
        left, bound, order = set(range(len(body))), set(), []
        at = first
        while True:
            pred, args = body[at]
            order.append({"at": at, "pred": pred, "args": list(args), "mask": [i for i, a in enumerate(args) if a[0] != "?" or a in bound]})
            left.discard(at)
            bound |= {a for a in args if a[0] == "?"}
            if not left:
                break
            at = min(left, key=lambda i: (-sum(a[0] != "?" or a in bound for a in body[i][1]), i))
        out.append(order)
    return out


def rules(formulas: DataFrame) -> DataFrame:
    """Horn rules of (doc_id, stmt_id, pos, fol), one for each literal of a head: variables are written ?x, steps has the
    orders of the body, and a fact has none. Formulas that are null, faulty or not Horn give no row."""

    def read(r: dict) -> Iterator[dict]:
        if fol.error(r["fol"]) is not None or (c := fol.clause(r["fol"])) is None:
            return
        names = sorted(fol.constants(fol.parse(r["fol"])))
        mark = lambda args: tuple(f"?{a}" if a in c["vars"] else a for a in args)
        body = [(p, mark(args)) for _, p, args in c["body"]]
        for neg, pred, args in c["heads"]:
            head = mark(args)
            held = {a for _, xs in body for a in xs}
            free = [(DOMAIN, (a,)) for a in dict.fromkeys(head) if a[0] == "?" and a not in held]
            yield {"doc_id": r["doc_id"], "stmt_id": r["stmt_id"], "pos": r["pos"], "head": {"neg": neg, "pred": pred, "args": list(head)}, "steps": orders(body + free), "names": names}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        atom = pa.struct([("at", pa.int32()), ("pred", pa.string()), ("args", pa.list_(pa.string())), ("mask", pa.list_(pa.int32()))])
        head = pa.struct([("neg", pa.bool_()), ("pred", pa.string()), ("args", pa.list_(pa.string()))])
        schema = pa.schema([("doc_id", pa.string()), ("stmt_id", pa.string()), ("pos", pa.int64()), ("head", head), ("steps", pa.list_(pa.list_(atom))), ("names", pa.list_(pa.string()))])
        for b in batches:
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in read(r)], schema=schema)

    return formulas.select(F.col("doc_id").cast("string"), F.col("stmt_id").cast("string"), F.col("pos").cast("long"), F.col("fol").cast("string")).mapInArrow(run, RULES)


def literal(pred: Column, args: Column) -> Column:
    return F.concat(pred, F.lit("("), F.array_join(args, ", "), F.lit(")"))


def _value(term: Column, bound: Column) -> Column:
    """A constant itself, or what a variable is bound to."""
    return F.when(term.startswith("?"), F.element_at(F.filter(bound, lambda e: e["v"] == term), 1)["c"]).otherwise(term)


def _key(atom: Column) -> Column:
    """What stands at the bound places of an atom."""
    return F.transform(atom["mask"], lambda p: _value(F.get(atom["args"], p), F.col("bound")))


def _unified(atom: Column, args: Column, bound: Column) -> tuple[Column, Column]:
    """Bindings after an atom meets a fact's arguments, and whether they agree."""
    pairs = F.zip_with(atom["args"], args, lambda a, c: F.struct(a.alias("v"), c.alias("c")))
    now = F.array_distinct(F.concat(bound, F.filter(pairs, lambda e: e["v"].startswith("?"))))
    same = F.forall(pairs, lambda e: e["v"].startswith("?") | (e["v"] == e["c"]))
    return now, same


def _step(rows: DataFrame, atom: Column) -> DataFrame:
    """rows whose fact (args) unifies with the atom: new bindings, and the fact among the premises."""
    now, same = _unified(atom, F.col("args"), F.col("bound"))
    premise = F.when(F.col("pred") != DOMAIN, F.array(F.struct(atom["at"].alias("at"), literal(F.col("pred"), F.col("args")).alias("lit")))).otherwise(F.array())
    out = rows.where(same).select("doc_id", "stmt_id", "pos", "head", "order", now.alias("bound"), F.concat("premises", premise).alias("premises"))
    return out.where(F.size("bound") == F.size(F.array_distinct(F.transform("bound", lambda e: e["v"]))))


def saturate(formulas: DataFrame, stop_at_clash: bool = True) -> DataFrame:
    """Ground literals that the Horn part of (doc_id, stmt_id, pos, fol) gives, with the first derivation of each:
    (doc_id, neg, pred, args, lit, round, stmt_id, premises).

    Of the derivations in a literal's first round, that by the earliest rule and then the least premises stays. Negative
    literals are kept but match no body. With stop_at_clash a document ends after the round in which a literal and its
    denial stand together. Facts have round 0 and no premises. A table without Horn formulas gives no rows.
    """
    r = cut(rules(formulas))
    is_rule = F.size("steps") > 0
    facts = r.where(~is_rule).groupBy("doc_id", F.col("head.neg").alias("neg"), F.col("head.pred").alias("pred"), F.col("head.args").alias("args"))
    facts = facts.agg(F.min(F.struct("pos", "stmt_id")).getField("stmt_id").alias("stmt_id"))
    open_docs = r.where(F.exists("steps", lambda s: F.exists(s, lambda a: a["pred"] == DOMAIN))).select("doc_id").distinct()
    domain = r.join(open_docs, "doc_id", "left_semi").select("doc_id", F.explode("names").alias("c")).distinct()
    domain = domain.select("doc_id", F.lit(False).alias("neg"), F.lit(DOMAIN).alias("pred"), F.array("c").alias("args"), F.lit(None).cast("string").alias("stmt_id"))
    known = facts.unionByName(domain).select("doc_id", "neg", "pred", "args", literal(F.col("pred"), F.col("args")).alias("lit"), F.lit(0).alias("round"), "stmt_id", F.array().cast("array<string>").alias("premises"))
    known = new = cut(known)
    ordered = cut(r.where(is_rule).select("doc_id", "stmt_id", "pos", "head", F.explode("steps").alias("order")))
    longest = ordered.agg(F.max(F.size("order"))).first()[0] or 0
    starts = ordered.withColumn("pred", F.col("order")[0]["pred"]).withColumn("arity", F.size(F.col("order")[0]["args"]))
    met = ordered.select("doc_id", F.explode(F.slice("order", 2, max(1, longest))).alias("a"))
    masks = cut(met.select("doc_id", F.col("a.pred").alias("pred"), F.size("a.args").alias("arity"), F.col("a.mask").alias("mask")).distinct())
    nothing = F.array().cast("array<struct<v:string,c:string>>")
    for k in count(1):
        if longest == 0:
            break
        at = new.where("not neg").select("doc_id", "pred", F.size("args").alias("arity"), "args").join(starts, ["doc_id", "pred", "arity"])
        part = _step(at.withColumn("bound", nothing).withColumn("premises", F.array().cast("array<struct<at:int,lit:string>>")), F.col("order")[0])
        whole = part.where(F.size("order") == 1)
        if longest > 1:
            held = known.where("not neg").select("doc_id", "pred", F.size("args").alias("arity"), "args").join(masks, ["doc_id", "pred", "arity"])
            held = held.select("doc_id", "pred", "arity", "mask", F.transform("mask", lambda i: F.get("args", i)).alias("key"), "args")
        for i in range(1, longest):
            a = F.col("order")[i]
            key = _key(a)
            keyed = part.where(F.size("order") > i).withColumn("pred", a["pred"]).withColumn("arity", F.size(a["args"])).withColumn("mask", a["mask"]).withColumn("key", key)
            part = _step(keyed.join(held, ["doc_id", "pred", "arity", "mask", "key"]), a)
            whole = whole.unionByName(part.where(F.size("order") == i + 1))
        args = F.transform(F.col("head.args"), lambda t: _value(t, F.col("bound")))
        made = whole.select("doc_id", F.col("head.neg").alias("neg"), F.col("head.pred").alias("pred"), args.alias("args"), "pos", "stmt_id", F.transform(F.array_sort("premises"), lambda p: p["lit"]).alias("premises"))
        made = made.withColumn("lit", literal(F.col("pred"), F.col("args"))).groupBy("doc_id", "neg", "lit").agg(F.min(F.struct("pos", "premises", "stmt_id", "pred", "args")).alias("by"))
        made = made.join(known.select("doc_id", "neg", "lit"), ["doc_id", "neg", "lit"], "left_anti")
        new = cut(made.select("doc_id", "neg", "by.pred", "by.args", "lit", F.lit(k).alias("round"), "by.stmt_id", "by.premises"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
        if stop_at_clash:
            new = new.join(clashes(known), "doc_id", "left_anti")
    return known.where(F.col("pred") != DOMAIN)


def clashes(literals: DataFrame) -> DataFrame:
    """(doc_id, lit, round): the first literal of a document that stands with its denial, of several in one round the least."""
    both = literals.groupBy("doc_id", "lit").agg(F.min("neg").alias("a"), F.max("neg").alias("b"), F.max("round").alias("round")).where("a <> b")
    return both.groupBy("doc_id").agg(F.min(F.struct("round", "lit")).alias("x")).select("doc_id", "x.lit", "x.round")


def refutations(literals: DataFrame) -> DataFrame:
    """The literals of saturate() that a document's first clash rests on, both its sides included: backward reachability
    along premises. Documents without a clash give no rows."""
    literals = cut(literals)
    need = literals.join(clashes(literals).select("doc_id", "lit"), ["doc_id", "lit"], "left_semi").select("doc_id", "neg", "lit")
    need = new = cut(need)
    while True:
        below = literals.join(new, ["doc_id", "neg", "lit"], "left_semi").select("doc_id", F.lit(False).alias("neg"), F.explode("premises").alias("lit")).distinct()
        new = cut(below.join(need, ["doc_id", "neg", "lit"], "left_anti"))
        if new.isEmpty():
            return literals.join(need, ["doc_id", "neg", "lit"], "left_semi")
        need = cut(need.unionByName(new))


def refuted(formulas: DataFrame) -> DataFrame:
    """refutations(saturate(formulas)) of (doc_id, stmt_id, pos, fol), worked out once for documents that are equal up to the names
    of constants."""
    docs = shapes.of_formulas(formulas, "stmt_id")
    rows = shapes.spread(docs, lambda some: refutations(saturate(formulas.join(some, "doc_id", "left_semi"))))
    inner = lambda lit: F.split(F.regexp_extract(lit, r"\((.*)\)\z", 1), ", ")
    new = lambda lit: literal(F.substring_index(lit, "(", 1), F.transform(inner(lit), shapes.renamed))
    args = F.transform("args", shapes.renamed)
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "neg", "pred", args.alias("args"), literal(F.col("pred"), args).alias("lit"), "round", "stmt_id", F.transform("premises", new).alias("premises"))


def proofs(steps: DataFrame) -> DataFrame:
    """(doc_id, text): one line for each literal, premises before what rests on them."""
    said = F.concat(F.when(F.col("neg"), "not ").otherwise(""), "lit", F.lit("  ["), F.coalesce("stmt_id", F.lit("-")), F.when(F.size("premises") > 0, F.concat(F.lit(" from "), F.array_join("premises", "; "))).otherwise(""), F.lit("]"))
    lines = steps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("round", "neg", "lit", said.alias("said")))).alias("l"))
    return lines.select("doc_id", F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("text"))
