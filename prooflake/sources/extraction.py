"""What an extractor returned, made into statements; and generated documents with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import balanced, unfenced

# Keys that an extractor's list may stand under, and types of statements.
WRAPPERS = ("statements", "items", "result", "data", "extractions")
TYPES = ("axiom", "derived_claim", "hypothetical", "rhetorical", "attributed", "non_propositional", "bridge")


def statements(raw: DataFrame, numbered: bool = True) -> DataFrame:
    """Statements of (doc_id, raw), the extractor's text: doc_id, stmt_id, pos, type, text, original_text.

    Takes a list, a list under one of WRAPPERS or a single object, inside a code fence or other words. Strings become axioms,
    nulls and empty statements go, unknown types become axiom, missing ids are s1, s2, ... by place among items kept. Text
    without JSON gives no rows. Without numbered, as streams need it, missing ids are null.
    """
    bare = unfenced(F.col("raw"))
    doc = raw.select("doc_id", F.coalesce(F.try_parse_json(bare), F.try_parse_json(balanced(bare))).alias("v"))
    lists = [F.try_variant_get("v", f"$.{key}", "array<variant>") for key in WRAPPERS]
    single = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v"))
    rows = doc.select("doc_id", F.posexplode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, single)).alias("pos", "item"))
    get = lambda key: F.try_variant_get("item", f"$.{key}", "string")
    is_text = F.schema_of_variant("item") == "STRING"
    plain = F.when(is_text, F.trim(F.try_variant_get("item", "$", "string")))
    rows = rows.where(F.schema_of_variant("item").startswith("OBJECT") | (plain != ""))
    rows = rows.withColumn("auto", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) if numbered else F.lit(None))
    text, original = F.coalesce(plain, get("decontextualized"), get("original_text"), F.lit("")), F.coalesce(plain, get("original_text"), get("decontextualized"), F.lit(""))
    kind = F.when(get("type").isin(*TYPES), get("type")).otherwise("axiom")
    out = rows.select("doc_id", F.coalesce(get("id"), F.concat(F.lit("s"), F.col("auto").cast("string"))).alias("stmt_id"), "pos", kind.alias("type"), text.alias("text"), original.alias("original_text"))
    return out.where("text <> '' or original_text <> ''")


def chain_documents(spark: SparkSession, per_cell: int, max_hops: int = 5, distractors: int = 2) -> DataFrame:
    """Documents of one chain of rules each: doc_id, hops, expected (1: the last statement denies what follows), text.

    Each pair of hops and answer has per_cell documents. Names differ by document, so none contradicts another. The facts
    before the denial, distractors among them, stand in an order drawn by hash.
    """
    n = per_cell * max_hops * 2
    d = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % max_hops + 1).cast("int").alias("hops"), ((F.col("id") / max_hops).cast("long") % 2).cast("int").alias("expected"))
    name = lambda i: F.concat(F.lit("kind"), "doc_id", F.lit("x"), i.cast("string"))
    rules = F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.concat(F.lit("Every "), name(i - 1), F.lit(" is a "), name(i), F.lit(".")))
    other = F.transform(F.sequence(F.lit(1), F.lit(distractors)), lambda i: F.concat(F.lit("Every stray"), "doc_id", F.lit("x"), i.cast("string"), F.lit(" is a thing"), "doc_id", F.lit("."))) if distractors else F.array().cast("array<string>")
    fact = F.concat(F.lit("Person"), "doc_id", F.lit(" is a "), name(F.lit(0)), F.lit("."))
    mixed = F.transform(F.array_sort(F.transform(F.concat(F.array(fact), rules, other), lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), lambda x: x["s"])
    denied = F.when(F.col("expected") == 1, name(F.col("hops"))).otherwise(F.concat(F.lit("stranger"), "doc_id"))
    last = F.concat(F.lit("Person"), "doc_id", F.lit(" is not a "), denied, F.lit("."))
    return d.select("doc_id", "hops", "expected", F.array_join(F.concat(mixed, F.array(last)), "\n").alias("text"))


def stress_documents(spark: SparkSession, per_cell: int = 4, depths: tuple[int, ...] = (5, 10, 15, 20), clutter: tuple[int, ...] = (0, 40, 100), seed: int = 7) -> DataFrame:
    """Deep chains among clutter: doc_id, depth, distractors, expected (1: a statement denies what the chain gives), statements,
    text. Every cell of depth, clutter and answer has per_cell documents.

    The wording of a rule or distractor and the order of all statements are drawn by keyed hash. Each thing has a name of its
    own, so that no distractor takes part in a conflict; in a consistent document the denial is of a thing without rules.
    """
    pick = lambda n, *of: F.pmod(F.xxhash64(F.lit(seed), "doc_id", *of), F.lit(n))
    cells = len(depths) * len(clutter) * 2
    d = spark.range(cells * per_cell).withColumnRenamed("id", "doc_id").withColumn("cell", (F.col("doc_id") % cells).cast("int"))
    d = d.withColumn("expected", F.col("cell") % 2).withColumn("depth", F.get(F.array(*map(F.lit, depths)), F.floor(F.col("cell") / 2).cast("int") % len(depths)))
    d = d.withColumn("distractors", F.get(F.array(*map(F.lit, clutter)), F.floor(F.col("cell") / (2 * len(depths))).cast("int")))
    thing = lambda i: F.concat(F.lit("Crate"), "doc_id", F.lit("n"), i.cast("string"))
    rung = lambda i: F.when(i > F.col("depth"), F.lit("insured")).otherwise(F.concat(F.lit("rung"), i.cast("string")))

    def rule(i):
        a, b, form = rung(i - 1), rung(i), pick(4, F.lit("rule"), i)
        return (
            F.when(form == 0, F.concat(F.lit("Every "), a, F.lit(" is a "), b, F.lit("."))).when(form == 1, F.concat(F.lit("All "), a, F.lit("s are "), b, F.lit("s.")))
            .when(form == 2, F.concat(F.lit("Each "), a, F.lit(" is a "), b, F.lit("."))).otherwise(F.concat(F.lit("If something is a "), a, F.lit(" then it is a "), b, F.lit(".")))
        )

    def distractor(i):
        a, b, form = thing(i + 2), F.concat(F.lit("rung"), pick(F.col("depth") + 1, F.lit("which"), i).cast("string")), pick(3, F.lit("other"), i)
        said = F.when(form == 0, F.lit(" is a ")).when(form == 1, F.lit(" was packed as a ")).otherwise(F.lit(" is stored as a "))
        return F.concat(a, said, b, F.lit("."))

    rules = F.transform(F.sequence(F.lit(1), F.col("depth") + 1), rule)
    others = F.when(F.col("distractors") > 0, F.transform(F.sequence(F.lit(1), F.greatest("distractors", F.lit(1))), distractor)).otherwise(F.array())
    ends = F.array(F.concat(thing(F.lit(1)), F.lit(" is a rung0.")), F.concat(thing(F.when(F.col("expected") == 1, 1).otherwise(2)), F.lit(" is not insured.")))
    drawn = F.array_sort(F.transform(F.concat(rules, ends, others), lambda s: F.struct(F.xxhash64(F.lit(seed), s).alias("h"), s.alias("s"))))
    lines = F.transform(drawn, lambda x: x["s"])
    return d.select("doc_id", "depth", "distractors", "expected", F.size(lines).alias("statements"), F.array_join(lines, "\n").alias("text"))
