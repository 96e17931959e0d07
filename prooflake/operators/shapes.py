"""Documents that are equal up to the names of their constants: one of each shape is worked out, the others take its result.

A document of at most MOST rows has a shape: its rows with each name that is no predicate replaced by its place in the document's
sorted names. Renaming that keeps the names' order changes no formula's reading and no comparison, so what is worked out for
one document holds for all of its shape. Documents of more rows, with signs beyond ASCII or with names that begin with _ are
shapes of their own; a corpus of documents that are all unlike is worked out document by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import cut, tasks

#: Rows of a document that a group holds at most.
MOST = 64
#: A shape is hot if more than one in so many documents has it; its result is broadcast.
HOT_SHARE = 1000
TERM = r"(?<!\w)(?!(?:forall|exists|and|or|not)\b)[A-Za-z]\w*\b(?!\s*\()"
ODD = r"[^ -~]|(?<!\w)_"


def first_rows(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """rows with k, their place in their document; no more than most + 1 of a document."""
    return rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col("k") <= most + 1)


def dealt(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of documents of at most most rows, dealt out by doc_id, so many to a task at any size; and (doc_id) of those of more
    rows, None if there are none."""
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    total, top = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    large = cut(sizes.where(F.col("n") > most).select("doc_id")) if top > most else None
    small = rows if large is None else rows.join(large, "doc_id", "left_anti")
    return small.repartition(tasks(rows, total), "doc_id"), large


def keyed(docs: DataFrame, good: Column, key: Column) -> DataFrame:
    """(doc_id, shape, names) of docs (doc_id, names, ...), written once; documents that are not good have no names."""
    shape = F.when(good, F.sha2(F.to_json(key), 256)).otherwise(F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return cut(docs.select("doc_id", shape.alias("shape"), F.when(good, F.col("names")).alias("names")))


def of_formulas(rows: DataFrame, *cols: str, most: int = MOST, good: Column | None = None) -> DataFrame:
    """(doc_id, shape, names) of documents of rows (doc_id, pos, *cols, fol); rows are alike only if cols are equal. good: what
    documents (names, s with the formulas' t) must have besides to be of a shape with others."""
    s = rows.select("doc_id", "pos", *cols, F.regexp_replace("fol", TERM, "\u0001").alias("t"), F.coalesce(F.regexp_extract_all("fol", F.lit(TERM), F.lit(0)), F.array().cast("array<string>")).alias("a"), F.coalesce(F.rlike("fol", F.lit(ODD)), F.lit(False)).alias("odd"))
    s = first_rows(s, most, "pos", *cols, "t")
    docs = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "pos", *cols, "t", "a"))).alias("s"), F.max("odd").alias("odd"))
    docs = docs.withColumn("names", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda r: r["a"])))))
    ranked = F.transform("s", lambda r: F.struct(*[r[c] for c in ("pos", *cols, "t")], F.transform(r["a"], lambda a: F.array_position("names", a)).alias("a")))
    low = F.size(F.filter("names", lambda n: n < "_"))
    alike = (F.size("s") <= most) & ~F.col("odd")
    return keyed(docs, alike if good is None else alike & good, F.struct(ranked.alias("s"), low.alias("low")))


def spread(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work gives for one document of each shape, for all documents: doc_id, names, rep and rep_names (of the document that
    was worked out) and work's other columns. work takes a DataFrame of doc_id and returns rows with the doc_id, of any type."""
    n = docs.groupBy("shape").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = cut(n.join(docs.select(F.col("doc_id").alias("rep"), F.col("names").alias("rep_names")), "rep"))
    found = work(reps.select(F.col("rep").alias("doc_id")))
    rest = [c for c in found.columns if c != "doc_id"]
    found = found.withColumn("rep", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).drop("doc_id")
    found = cut(reps.join(found, "rep").select("shape", "rep", "rep_names", "n", *rest))
    return matched(docs, reps, found).select("doc_id", "names", "rep", "rep_names", *rest)


def matched(docs: DataFrame, every: DataFrame, found: DataFrame) -> DataFrame:
    """docs joined by shape with found (shape, n, ...), the rows of shapes; every is (shape, n), all shapes and how many documents
    have each. What hot shapes have is broadcast."""
    total = every.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    many = docs.join(F.broadcast(found.where(hot)), "shape")
    few = docs.join(F.broadcast(every.where(hot).select("shape")), "shape", "left_anti").join(found.where(~hot), "shape")
    return many.unionByName(few)


def renamed(name: Column) -> Column:
    """A name of the document that was worked out as the document at hand has it."""
    at = F.array_position("rep_names", name)
    return F.when(F.col("names").isNull() | (at == 0), name).otherwise(F.get(F.col("names"), (at - 1).cast("int")))
