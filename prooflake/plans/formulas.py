"""Queries over formulas, spans, extractor output, runs and verified statements, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas, text
from ..operators import admission, relational, render, report, run, vocab
from ..sources import corpora, extraction, runs
from ..sources.corpora import STATEMENTS_SQL, table
from .catalog import query

# Formulas over orders, one for each order; every document is a customer.
_FOL = """CASE o_orderkey % 5 WHEN 0 THEN 'forall x. (Buyer(x) -> Person(x))' WHEN 1 THEN 'Requires(c' || o_orderkey || ', d' || o_orderkey || ')'
  WHEN 2 THEN 'not Person(c' || o_orderkey || ')' WHEN 3 THEN 'forall x. (OldBuyer(x) -> Person(x))' ELSE 'Between(a, b, c)' END"""
_FORMULAS = f"SELECT o_custkey AS doc_id, o_orderkey AS pos, {_FOL} AS fol FROM orders"
_PREDS = """SELECT doc_id, pos, unnest(CASE pos % 5 WHEN 0 THEN ['Buyer', 'Person'] WHEN 1 THEN ['Requires'] WHEN 2 THEN ['Person'] WHEN 3 THEN ['OldBuyer', 'Person'] ELSE ['Between'] END) AS pred
  FROM (SELECT o_custkey AS doc_id, o_orderkey AS pos FROM orders)"""


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS pos", f"{_FOL} AS fol")


@query(f"SELECT pos, CASE pos % 5 WHEN 0 THEN 14 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 14 ELSE 8 END AS n, '' AS rest FROM ({_FORMULAS})")
def fol_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("pos", F.size(formulas.tokens(F.col("fol"))).alias("n"), formulas.untokenized(F.col("fol")).alias("rest"))


@query(f"SELECT doc_id, pred, min(pos) AS first_pos, count(*) AS statements FROM ({_PREDS}) GROUP BY doc_id, pred")
def predicate_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.inventory(_formulas(spark, sf_dir))


@query(f"SELECT doc_id, pos, pred, min(pos) OVER (PARTITION BY doc_id, pred) < pos AS known FROM ({_PREDS})")
def predicate_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.known_before(_formulas(spark, sf_dir))


@query(f"SELECT pos, CASE pos % 5 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS arity FROM ({_FORMULAS})")
def fol_max_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("pos", formulas.max_arity(F.col("fol")).alias("arity"))


@query(f"SELECT pos, pos % 5 IN (0, 3) AS modifier_only FROM ({_FORMULAS})")
def modifier_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("pos", formulas.modifier_only(F.col("fol"), F.lit("forall x. (Buyer(x) -> Person(x))")).alias("modifier_only"))


@query(f"""SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN fol WHEN pos % 5 = 1 THEN 'PrerequisiteFor(d' || pos || ', c' || pos || ')' WHEN pos % 5 = 3 THEN 'forall x. (Buyer(x) -> Person(x))' ELSE fol END AS fol FROM ({_FORMULAS})""")
def alias_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").selectExpr("o_custkey AS doc_id").distinct()
    pairs = docs.selectExpr("doc_id", "inline(array(struct('OldBuyer' AS old, 'Buyer' AS new, false AS swap), struct('Requires' AS old, 'PrerequisiteFor' AS new, true AS swap)))")
    return vocab.apply_aliases(_formulas(spark, sf_dir), pairs)


@query(f"SELECT pos, strpos(text, split_part(text, ' ', 2)) - 1 AS start, strpos(text, split_part(text, ' ', 2)) - 1 + length(split_part(text, ' ', 2)) AS \"end\" FROM ({STATEMENTS_SQL}) WHERE split_part(text, ' ', 2) <> ''")
def snippet_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part(F.col("text"), F.lit(" "), F.lit(2))
    s = corpora.phrases(spark, sf_dir).where(word != "").select("pos", text.span(F.col("text"), F.concat(F.lit(" "), word)).alias("s"))
    return s.select("pos", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"SELECT pos, CASE WHEN length(text) > 20 THEN substr(text, 1, 17) || '...' ELSE text END AS label FROM ({STATEMENTS_SQL})")
def short_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", text.shortened(F.col("text"), 20).alias("label"))


@query("""SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS url FROM pages""")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.xml_escaped(F.col("url")).alias("url"))


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 4 = 1 THEN 's1' ELSE 'e' || event_id END AS stmt_id, CASE WHEN event_id % 4 = 2 THEN 'derived_claim' ELSE 'axiom' END AS type, 'User ' || user_id || ' is {odd}.' AS text FROM events WHERE event_id % 4 <> 3")
def extraction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "concat('User ', user_id, ' is {odd}.')"
    raw = f"""CASE event_id % 4 WHEN 0 THEN concat('```json\\n[null, {{"id": "e', event_id, '", "type": "odd", "original_text": "', {says}, '"}}]\\n```')
      WHEN 1 THEN concat('["', {says}, '", "  "]') WHEN 2 THEN concat('Here: {{"items": [{{"id": "e', event_id, '", "type": "derived_claim", "decontextualized": "', {says}, '"}}]}} as asked')
      ELSE 'no claims here' END"""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{raw} AS raw")
    return extraction.statements(rows).select("doc_id", "stmt_id", "type", "text")


@query("""SELECT CAST(id AS BIGINT) AS doc_id, CAST(id % 5 + 1 AS INT) AS hops, CAST((id // 5) % 2 AS INT) AS expected, CAST(id % 5 + 5 AS INT) AS n,
    'Person' || id || ' is not a ' || CASE WHEN (id // 5) % 2 = 1 THEN 'kind' || id || 'x' || (id % 5 + 1) ELSE 'stranger' || id END || '.' AS last FROM range(600) t(id)""")
def chain_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return extraction.chain_documents(spark, 60).select("doc_id", "hops", "expected", F.size(lines).alias("n"), F.element_at(lines, -1).alias("last"))


# Verified statements over lineitem: each order is a document.
_PROPS = """SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'derived_claim' WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'bridge' ELSE 'axiom' END AS type,
  CASE WHEN l_linenumber = 5 THEN 'quarantined' ELSE 'accepted' END AS status, CASE WHEN l_linenumber <= 2 AND l_orderkey % 4 = 0 THEN 'contradicts' WHEN l_linenumber % 3 = 0 THEN 'entailed' END AS verdict FROM lineitem"""


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_PROPS.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    conflict = "CASE WHEN verdict = 'contradicts' THEN array(concat('s', 3 - n)) ELSE array() END"
    support = "CASE WHEN verdict = 'entailed' THEN array('s1') ELSE array() END"
    return rows.selectExpr("doc_id", "concat('s', n) AS stmt_id", "type", "status", "verdict", f"{conflict} AS conflict", f"{support} AS support", "concat('Line ', n) AS text")


@query(f"SELECT coalesce(verdict, status) AS outcome, count(*) AS n FROM ({_PROPS}) GROUP BY 1")
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_props(spark, sf_dir))


@query(f"""WITH p AS ({_PROPS}), s AS (SELECT DISTINCT doc_id FROM p WHERE verdict = 'contradicts')
    SELECT s.doc_id, 's1,s2' AS members, coalesce(bool_or(p.type = 'bridge'), false) AS bridged FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND p.n <= 2 GROUP BY s.doc_id""")
def inconsistent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.conflict_sets(_props(spark, sf_dir)).select("doc_id", F.array_join("members", ",").alias("members"), "bridged")


@query(f"""WITH p AS ({_PROPS}) SELECT doc_id, 's1' AS src, 's' || n AS dst, 'support' AS label FROM p WHERE verdict = 'entailed'
    UNION ALL SELECT DISTINCT doc_id, 's2', 's1', 'conflict' FROM p WHERE verdict = 'contradicts'""")
def theory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.edges(_props(spark, sf_dir))


@query(f"""SELECT doc_id, 's' || n AS stmt_id, k AS kind FROM (SELECT *, CASE WHEN status = 'quarantined' THEN 'excluded' WHEN type <> 'derived_claim' THEN type ELSE coalesce(verdict, 'unknown') END AS k FROM ({_PROPS}))""")
def theory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nodes(_props(spark, sf_dir)).select("doc_id", "stmt_id", "kind")


@query()
def theory_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dot(_props(spark, sf_dir))


_RUNS = "o_orderkey AS doc_id, o_orderpriority AS system, o_orderkey % 7 AS statements, o_orderkey % 3 AS quarantined, o_custkey % 100 AS tokens, o_orderkey % 11 / 2.0 AS seconds"


@query(f"""SELECT system, round(avg(CASE WHEN statements > 0 THEN quarantined::DOUBLE / statements END), 9) AS quarantine_rate, round(avg(tokens), 9) AS tokens_per_doc, round(avg(seconds), 9) AS seconds_per_doc,
    sum(tokens)::BIGINT AS tokens FROM (SELECT {_RUNS} FROM orders) GROUP BY system""")
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr(*_RUNS.split(", ")).withColumn("seconds", F.col("seconds").cast("double"))
    m = report.run_means(runs, "system")
    return m.select("system", *[F.round(c, 9).alias(c) for c in m.columns[1:4]], "tokens")


@query("""SELECT count(*) FILTER (e = 1 AND f = 1) AS tp, count(*) FILTER (e = 0 AND f = 1) AS fp, count(*) FILTER (e = 1 AND f = 0) AS fn, count(*) FILTER (e = 0 AND f = 0) AS tn, count(*) FILTER (f IS NULL) AS errors
    FROM (SELECT c_custkey % 2 AS e, CASE WHEN n >= 10 THEN 1 WHEN n IS NOT NULL THEN 0 END AS f FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)""")
def gold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "c_custkey % 2 AS expected")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg((F.count("*") >= 10).cast("int").alias("found"))
    return relational.confusion(report.scored(gold, found))


@query()
def theory_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.svg(_props(spark, sf_dir))


@query(f"""WITH p AS ({_PROPS}) SELECT doc_id, count(*) AS statements, count(*) FILTER (status = 'quarantined') AS quarantined, CASE WHEN bool_or(verdict = 'contradicts') THEN 1 ELSE 0 END::BIGINT AS inconsistent_sets,
    coalesce(any_value(f.n), 0)::BIGINT AS screener_flags FROM p LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 3 AS n FROM orders WHERE o_orderkey % 3 > 0) f ON f.k = doc_id GROUP BY doc_id""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "explode(sequence(1, int(o_orderkey % 3))) AS ix").where("doc_id % 3 > 0")
    return render.batch_summary(_props(spark, sf_dir), flags).drop("line")


@query("""SELECT CAST(id AS BIGINT) AS doc_id, [5, 10, 15, 20][(id % 24) // 2 % 4 + 1]::INT AS depth, [0, 40, 100][(id % 24) // 8 + 1]::INT AS distractors, CAST(id % 2 AS INT) AS expected,
    ([5, 10, 15, 20][(id % 24) // 2 % 4 + 1] + 3 + [0, 40, 100][(id % 24) // 8 + 1])::INT AS statements FROM range(96) t(id)""")
def stress_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.stress_documents(spark).drop("text")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey % 2 = 1 OR o_custkey IS NULL")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey")
    return runs.pending(todo, table(spark, sf_dir, "orders").select("o_custkey").where("o_custkey % 2 = 0"), "o_custkey").select("doc_id")


# A run over customers: each order adds what its status says, and every customer has two rules and a claim. The translator's
# formula is there for two orders of three and names predicates and constants in other ways.
_LEDGER = """SELECT o_custkey AS doc_id, concat('o', o_orderkey) AS stmt_id, 10 + o_orderkey AS pos, 'axiom' AS type,
  CASE o_orderstatus WHEN 'F' THEN concat('C1', o_custkey, ' is a buyer.') WHEN 'O' THEN concat('C1', o_custkey, ' is not a payer.') ELSE concat('C1', o_custkey, ' is typically a payer.') END AS text,
  CASE WHEN o_orderkey % 3 > 0 AND o_orderstatus = 'F' THEN concat('Buyers(c1_', o_custkey, ')') WHEN o_orderkey % 3 > 0 AND o_orderstatus = 'O' THEN concat('Nonpayer(c1_', o_custkey, ')') END AS other FROM {orders}
  UNION ALL SELECT c_custkey, 'r', 0, 'axiom', 'Every buyer is a payer.', NULL FROM {customer}
  UNION ALL SELECT c_custkey, 'z', 1L << 38, 'derived_claim', concat('C1', c_custkey, ' is a payer.'), concat('Payer(c1_', c_custkey, ')') FROM {customer}"""
_CUSTOMERS = "SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.run(spark.sql(_LEDGER, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer")))


@query(f"""SELECT c_custkey AS doc_id, (f + o + 2)::BIGINT AS accepted, p::BIGINT AS quarantined, (greatest(f - 1, 0) + greatest(o - 1, 0))::BIGINT AS repeated,
    o = 0 AS consistent, CASE WHEN o > 0 THEN 'contradicts' WHEN f > 0 THEN 'entailed' ELSE 'not_entailed' END AS claim, CASE WHEN o = 0 AND f > 0 THEN 2 ELSE 0 END AS premises FROM ({_CUSTOMERS})""")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.col("stmt_id") == "z"
    out = _ledger(spark, sf_dir).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count("first").alias("repeated"),
        F.bool_and(F.when(claim, F.col("consistent"))).alias("consistent"), F.max(F.when(claim, F.col("verdict"))).alias("claim"), F.max(F.when(claim, F.size("support"))).alias("premises"),
    )
    return out


@query(f"""WITH c AS ({_CUSTOMERS}), n AS (SELECT count(*) FILTER (o > 0) AS bad, count(*) FILTER (o = 0 AND f > 0) AS proved, count(*) FILTER (o = 0 AND f = 0) AS bare, sum(p) AS held, sum(f + o + 2) AS good FROM c)
    SELECT outcome, n::BIGINT AS n FROM (SELECT unnest(['contradicts', 'entailed', 'not_entailed', 'quarantined', 'accepted']) AS outcome, unnest([2 * bad, proved, bare, held, good - 2 * bad - proved - bare]) AS n FROM n) WHERE n > 0""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_ledger(spark, sf_dir))


@query("""WITH c AS (SELECT c_custkey AS doc_id, min(o_orderkey) FILTER (o_orderstatus = 'F') AS f, min(o_orderkey) FILTER (o_orderstatus = 'O') AS o FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT doc_id, 'z' AS src, 'o' || o AS dst, 'conflict' AS label FROM c WHERE o IS NOT NULL UNION ALL
    SELECT doc_id, unnest(['r', 'o' || f]), 'z', 'support' FROM c WHERE o IS NULL AND f IS NOT NULL""")
def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.edges(_ledger(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("long"))


# Statements with two candidates over orders: k, type, text, rule, other, and what the gate says.
_EVERY, _CATS = "Every cat is an animal.", "forall x. (Cat(x) -> Animal(x))"
_TWO = [
    ("rhetorical", _EVERY, _CATS, None, "type", None, None), ("axiom", "Cats typically purr.", "Purring(cats)", None, "hedged", None, None),
    ("axiom", "One must pay.", "Payer(one)", None, "norm", None, None), ("axiom", "Cats purr.", None, "P((", "no formula", None, None),
    ("axiom", _EVERY, _CATS, "forall y. (not Animal(y) -> not Cat(y))", "agreed", 0.95, _CATS), ("axiom", _EVERY, _CATS, "forall x. (Dog(x) -> Mineral(x))", "one faithful", 0.75, _CATS),
    ("axiom", "Every black cat is an animal.", _CATS, "forall x. (BlackCat(x) -> Animal(x))", "modifier only", 0.75, _CATS), ("axiom", _EVERY, _CATS, "forall x. (Animal(x) -> Cat(x))", "ambiguous", None, None),
    ("axiom", _EVERY, "Dog(rex)", "Mineral(stone)", "none faithful", None, None), ("axiom", "Tom is a cat.", "Cat(tom)", None, "rule faithful", 0.8, "Cat(tom)"),
    ("axiom", "Tom is a cat.", None, "Cat(tom)", "other faithful", 0.7, "Cat(tom)"), ("axiom", "Tom is a cat.", "Planet(pluto)", None, "not faithful", None, None),
    ("axiom", "Ann loves Bob.", "LovesBob(ann)", "Loves(ann, bob)", "greater arity", 0.75, "Loves(ann, bob)"), ("axiom", "Every man loves a woman.", "forall x. (Man(x) -> exists y. (Loves(x, y)))", None, "relational role", None, None),
]
_SQL = lambda x: "NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else f"'{x}'"
_PICK = lambda at, sql=_SQL: f"CASE o_orderkey % {len(_TWO)} {' '.join(f'WHEN {k} THEN {sql(c[at])}' for k, c in enumerate(_TWO))} END"


@query(f"""SELECT doc_id, CASE WHEN confidence IS NOT NULL THEN 'accepted' WHEN reason = 'ambiguous' THEN 'ambiguous' ELSE 'quarantined' END AS status, confidence, reason, fol FROM (
    SELECT o_orderkey AS doc_id, {_PICK(4)} AS reason, {_PICK(5)} AS confidence, {_PICK(6)} AS fol FROM orders)""")
def gate_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "'s' AS stmt_id", "1 AS pos", *[f"{_PICK(at)} AS {name}" for at, name in enumerate(("type", "text", "rule", "other"))])
    return admission.gate(said, guard_deontic=True, allow_relations=True).select("doc_id", "status", "confidence", "reason", "fol")
