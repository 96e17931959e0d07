"""From a folder of documents to a folder of artefacts in one call.

documents -> statements (long texts by chunks, pooled and numbered anew) -> store (operators/run.py) with spans -> screener ->
artefacts. Each stage is one plan over all documents; the folder is one scan. Every id that a report names can be followed to
a span of the source: `lineage` has, for each statement as extracted, the statement that stands for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cues import retyped
from ..functions.formulas import predicates
from ..functions.text import span
from ..sources import extraction, folder, runs
from . import admission, relational, render, report, run, segment, theory
from .runtime import cut

#: Texts of fewer characters are not cut into chunks.
THRESHOLD = 2000
ARTEFACTS = ("graph.dot", "graph.svg", "report.json", "report.md", "store.json", "theory_tree.txt")


@dataclass
class Analysis:
    """What a run over documents gives: the store, pairs that the screener flags (by statement ids), the number of chunks of
    each document, and the lineage (doc_id, source_id, stmt_id) of statements."""

    store: DataFrame
    flags: DataFrame
    chunks: DataFrame
    lineage: DataFrame


def chunked(docs: DataFrame, no_chunk: bool = False, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_chunks, long) of docs (doc_id, raw_text): 1 for short texts and with no_chunk, else how many chunks its
    paragraphs make."""
    d = docs.select("doc_id", "raw_text", ((F.length("raw_text") >= threshold) & F.lit(not no_chunk)).alias("long"))
    paras = segment.paragraphs(d.where("long").select("doc_id", "raw_text"))
    many = segment.chunks(paras.select("doc_id", "para_ix", F.length("text").alias("n"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(many, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(1)).alias("n_chunks"), "long")


def statements(docs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements (doc_id, stmt_id, pos, type, text, original) of docs (doc_id, extraction), and their lineage (doc_id,
    source_id, stmt_id). Short documents keep the extractor's ids, an id that comes again with its place after it; of long ones
    the first statement of each wording is kept and numbered anew, and the others' lineage leads to it."""
    s = extraction.statements(docs.select("doc_id", F.col("extraction").alias("raw")).where("raw IS NOT NULL"))
    s = s.select("doc_id", F.col("stmt_id").alias("source_id"), "pos", retyped(F.col("type"), F.col("text")).alias("type"), "text", F.col("original_text").alias("original"))
    s = s.join(sizes.select("doc_id", "long"), "doc_id").withColumn("key", F.when(F.col("long"), segment.dedup_key(F.col("text"))).otherwise(F.col("pos").cast("string")))
    s = s.where("key <> ''").withColumn("first", F.min("pos").over(W.partitionBy("doc_id", "key")))
    again = F.row_number().over(W.partitionBy("doc_id", "source_id").orderBy("pos"))
    number = F.dense_rank().over(W.partitionBy("doc_id").orderBy("first"))
    own = F.when(F.col("again") > 1, F.concat("source_id", F.lit("#"), F.col("again").cast("string"))).otherwise(F.col("source_id"))
    s = s.withColumn("again", again).withColumn("stmt_id", F.when(F.col("long"), F.concat(F.lit("s"), number.cast("string"))).otherwise(own))
    s = cut(s)
    return s.where("pos = first").select("doc_id", "stmt_id", "pos", "type", "text", "original"), s.select("doc_id", "source_id", "stmt_id")


def translations(docs: DataFrame) -> DataFrame:
    """(doc_id, stmt_id, other) of docs (doc_id, translation); a formula null is none."""
    return docs.select("doc_id", F.explode(F.from_json("translation", "map<string,string>")).alias("stmt_id", "other")).where("other IS NOT NULL")


def bridges(docs: DataFrame) -> DataFrame:
    """(doc_id, stmt_id, fol, gloss) of docs (doc_id, bridges)."""
    rows = docs.select("doc_id", F.explode(F.from_json("bridges", "array<struct<id:string,fol:string,gloss:string>>")).alias("b"))
    return rows.select("doc_id", "b.*").select("doc_id", F.col("id").alias("stmt_id"), "fol", "gloss").where("stmt_id IS NOT NULL AND fol IS NOT NULL")


def analyse(docs: DataFrame, with_bridges: bool = True, no_chunk: bool = False, **options) -> Analysis:
    """Runs documents (doc_id, raw_text, extraction, translation, bridges) with the options of run.run.

    A document without statements has no rows in the store. doc_id is unique. Without documents every table is empty."""
    docs = cut(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    sizes = cut(chunked(docs, no_chunk))
    s, lineage = statements(docs, sizes)
    s = cut(s.join(translations(docs), ["doc_id", "stmt_id"], "left"))
    store = run.run(s, bridges(docs) if with_bridges else None, **options)
    words = s.select("doc_id", "stmt_id", "original")
    store = store.drop("original").join(words, ["doc_id", "stmt_id"], "left").join(docs.select("doc_id", "raw_text"), "doc_id")
    store = cut(store.withColumn("span", span(F.col("raw_text"), F.col("original"))).drop("raw_text"))
    flags = relational.screener(s.select("doc_id", "pos", "text"))
    ids = s.select("doc_id", "pos", "stmt_id")
    for c in ("a", "b"):
        flags = flags.join(ids.select("doc_id", F.col("pos").alias(c), F.col("stmt_id").alias(f"_{c}")), ["doc_id", c])
    return Analysis(store, cut(flags.select("doc_id", F.col("_a").alias("a"), F.col("_b").alias("b"), "jaccard", "signal")), sizes.select("doc_id", "n_chunks"), lineage)


def artefacts(done: Analysis) -> DataFrame:
    """(doc_id, name, text): the artefacts of each document of the store, one row each of ARTEFACTS."""
    store = done.store
    cols = ["stmt_id", "type", "status", "confidence", "reason", "shape", "text", "original", "span", "fol", "first", "verdict", "support", "conflict", "note", "cluster"]
    rows = F.array_sort(F.collect_list(F.struct("pos", "stmt_id", F.struct(*cols).alias("p"))))
    props = store.groupBy("doc_id").agg(F.transform(rows, lambda x: x["p"]).alias("p"))
    outcome = F.coalesce("verdict", "status").alias("outcome")
    counts = store.groupBy("doc_id", outcome).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("summary"))
    groups = store.where("cluster IS NOT NULL").groupBy("doc_id", "cluster").agg(F.count("*").alias("n_statements"), F.min("consistent").alias("consistent"), F.array_sort(F.collect_list("stmt_id")).alias("statement_ids"), F.max("note").alias("note"))
    groups = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "n_statements", "consistent", "statement_ids", "note"))).alias("clusters"))
    named = lambda c, found: store.select("doc_id", F.explode(found).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias(c))
    screened = done.flags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "jaccard", "signal"))).alias("screener"))
    whole = props.join(counts, "doc_id").join(done.chunks.withColumnRenamed("n_chunks", "num_chunks"), "doc_id")
    for more in (groups, screened, named("predicates", predicates(F.col("fol"))), named("constants", admission.constants(F.col("fol")))):
        whole = whole.join(more, "doc_id", "left")
    shown = F.struct(F.col("doc_id").alias("source"), (F.col("num_chunks") > 1).alias("chunked"), "num_chunks", "summary", F.col("p").alias("propositions"), "clusters", "screener", "predicates", "constants")
    trees = cut(theory.tree(store))
    texts = {"store.json": props.select("doc_id", F.to_json("p").alias("text")), "report.json": whole.select("doc_id", F.to_json(shown).alias("text")), "report.md": theory.markdown(store, done.flags, trees), "theory_tree.txt": trees, "graph.dot": report.dot(store), "graph.svg": render.svg(store)}
    out = None
    for name, df in texts.items():
        df = df.select("doc_id", F.lit(name).alias("name"), F.col(df.columns[1]).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


def run_folder(spark: SparkSession, source: str, target: str, resume: bool = True, **options) -> DataFrame:
    """Analyses the documents of the folder source and leaves their artefacts in target/artefacts, the tables of the run in
    target/tables and its stages' times in target/timing. Returns what was done: (doc_id, inputs).

    With resume, documents whose inputs are listed in target/done are left alone. They are listed after their artefacts are
    written, and artefacts replace those of an earlier try, so a run that was killed and is run again leaves what one run does.
    """
    stages = runs.Stages()
    with stages.stage("read"):
        docs = cut(folder.documents(spark, source))
        if resume and runs.exists(spark, f"{target}/done"):
            docs = cut(runs.pending(docs, spark.read.parquet(f"{target}/done"), "doc_id", "inputs"))
    done = docs.select("doc_id", "inputs")
    with stages.stage("analyse"):
        found = analyse(docs, **options)
    with stages.stage("write"):
        batch = f"inputs={docs.agg(F.sha2(F.concat_ws(' ', F.array_sort(F.collect_list(F.xxhash64('doc_id', 'inputs')))), 256)).first()[0][:16]}"
        for name in ("store", "flags", "chunks", "lineage"):
            getattr(found, name).write.mode("overwrite").parquet(f"{target}/tables/{name}/{batch}")
        folder.write_artefacts(artefacts(found), f"{target}/artefacts")
        done.write.mode("append").parquet(f"{target}/done")
    stages.table(spark).coalesce(1).write.mode("overwrite").json(f"{target}/timing/{batch}")
    return done
