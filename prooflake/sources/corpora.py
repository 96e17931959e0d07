"""Inputs: documents, fixtures and checkpoints, and corpora of statements made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: One statement per event; what it says follows from event_id alone.
PHRASE = """CASE event_id % 14
 WHEN 0 THEN concat('User ', user_id, ' is active.')
 WHEN 1 THEN concat('User ', user_id, ' is not active.')
 WHEN 2 THEN concat('User ', user_id, ' is inactive.')
 WHEN 3 THEN concat('User ', user_id, ' is typically active.')
 WHEN 4 THEN concat('User ', user_id, ' must pay.')
 WHEN 5 THEN concat('User ', user_id, ' has more than ', event_id % 7, ' items.')
 WHEN 6 THEN concat('User ', user_id, ' left because of delays.')
 WHEN 7 THEN concat('User ', user_id, ' came before user ', event_id % 9, '.')
 WHEN 8 THEN concat('User ', user_id, ' is in group ', event_id % 5, '.')
 WHEN 9 THEN 'Every user is in some group.'
 WHEN 10 THEN 'All users are customers.'
 WHEN 11 THEN 'No customer is a robot.'
 WHEN 12 THEN concat('Therefore, user', user_id, ' is a customer.')
 ELSE concat('User', user_id, ' is a customer.') END"""
STATEMENTS_SQL = f"SELECT user_id AS doc_id, event_id AS pos, {PHRASE} AS text FROM events"

STATEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "type", "original_text", "decontextualized", "speaker")] + [T.StructField("depends_on", T.ArrayType(T.StringType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text): a document per user, a statement per event."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id AS pos", f"{PHRASE} AS text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, raw_text): whole UTF-8 files named by their stem."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("raw_text"))


def extraction_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, stmt_id, type, ...) from JSON arrays of statements named <stem>.extraction.json; missing types are axiom,
    missing ids are s1, s2, ..."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = F.regexp_extract("file", r"([^/]+?)\.extraction\.json$", 1)
    rows = raw.select(doc.alias("doc_id"), F.posexplode(F.from_json("value", T.ArrayType(STATEMENT))).alias("pos", "s"))
    text = F.coalesce("s.decontextualized", "s.original_text")
    return rows.select(
        "doc_id", "pos",
        F.coalesce("s.id", F.concat(F.lit("s"), F.col("pos") + 1)).alias("stmt_id"),
        F.coalesce("s.type", F.lit("axiom")).alias("type"),
        F.coalesce("s.original_text", text).alias("original_text"), text.alias("decontextualized"),
        F.coalesce("s.speaker", F.lit("author")).alias("speaker"),
        F.coalesce("s.depends_on", F.array().cast("array<string>")).alias("depends_on"),
    )


def translation_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, stmt_id, fol) from JSON objects named <stem>.translation.json."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = F.regexp_extract("file", r"([^/]+?)\.translation\.json$", 1)
    return raw.select(doc.alias("doc_id"), F.explode(F.from_json("value", "map<string,string>")).alias("stmt_id", "fol"))


def bridges(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, stmt_id, fol, gloss) from JSON arrays named <stem>.bridges.json; the gloss defaults to the formula."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = F.regexp_extract("file", r"([^/]+?)\.bridges\.json$", 1)
    rows = raw.select(doc.alias("doc_id"), F.explode(F.from_json("value", "array<struct<id:string,fol:string,gloss:string>>")).alias("b"))
    return rows.select("doc_id", F.col("b.id").alias("stmt_id"), F.col("b.fol").alias("fol"), F.coalesce("b.gloss", "b.fol").alias("gloss"))


def cache_key(stmt_id, text):
    """Checkpoint key of a translation: id|first 12 hex digits of the text's SHA-1."""
    return F.concat(stmt_id.cast("string"), F.lit("|"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def latest_checkpoint(lines: DataFrame) -> DataFrame:
    """(key, fol) from (line_no, value) JSON lines: torn lines are dropped and the last line of a key holds."""
    parsed = lines.select("line_no", F.from_json("value", "key string, fol string", {"mode": "PERMISSIVE"}).alias("j")).where("j.key is not null")
    return parsed.groupBy(F.col("j.key").alias("key")).agg(F.max_by("j.fol", "line_no").alias("fol"))


def retry_after(message):
    """Seconds of '2', '2s' or '2m59.56s'; null otherwise."""
    minutes = F.regexp_extract(message, r"^(?:(\d+)m)?(\d+(?:\.\d+)?)s?$", 1)
    seconds = F.regexp_extract(message, r"^(?:(\d+)m)?(\d+(?:\.\d+)?)s?$", 2)
    return F.when(seconds != "", F.when(minutes != "", minutes.cast("double") * 60).otherwise(0.0) + seconds.cast("double"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over orders: (doc_id, pos, text). Rules rung0 -> rung1 -> ... -> transferable, the subject is a rung0, and a
    denial that anybody is transferable: of the subject where the order's status is F, else of another name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("hops"), (F.col("o_orderstatus") == "F").alias("bad"))
    rung = lambda k: F.when(k == F.col("hops"), F.lit("transferable")).otherwise(F.concat(F.lit("rung"), k.cast("string")))
    rules = o.select("doc_id", "hops", "bad", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("k"))
    rules = rules.select("doc_id", F.col("k").alias("pos"), F.concat(F.lit("Every "), rung(F.col("k")), F.lit(" is a "), rung(F.col("k") + 1), F.lit(".")).alias("text"))
    facts = o.select("doc_id", F.col("hops").alias("pos"), F.concat(F.lit("Item"), F.col("doc_id"), F.lit(" is a rung0.")).alias("text"))
    denials = o.select("doc_id", (F.col("hops") + 1).alias("pos"), F.concat(F.when(F.col("bad"), F.lit("Item")).otherwise(F.lit("Other")), F.col("doc_id"), F.lit(" is not transferable.")).alias("text"))
    return rules.unionByName(facts).unionByName(denials)


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) located-in edges customer -> nation -> region and supplier -> nation."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return c.unionByName(s).unionByName(n)


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) requires edges p -> p div 2, and p div 8 -> p for every 97th part, which closes cycles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")).where("p > 0")
    return p.select(F.col("p").alias("src"), F.expr("p div 2").alias("dst")).unionByName(p.where("p % 97 = 0").select(F.expr("p div 8").alias("src"), F.col("p").alias("dst")))


REQUIRES_SQL = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 8, p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 97 = 0"
