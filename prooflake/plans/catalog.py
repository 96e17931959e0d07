"""Registered queries of the engine's own operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cues, morph
from ..functions.numbers import rounded_sql
from ..operators import graphs, relational, segment, translate, verdict, vocab
from ..sources import corpora
from ..sources.corpora import REQUIRES_SQL, STATEMENTS_SQL, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- text ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS para_ix, text FROM (
    SELECT doc_id, k, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS text FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*')) AS part, unnest(range(len(regexp_split_to_array(text, '\\n\\s*')))) AS k FROM documents)) WHERE text <> ''""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return segment.paragraphs(docs, r"\n\s*").select("doc_id", "para_ix", "text")


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 2 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker FROM conversations")
def speaker_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("turn") % 2 == 0, F.col("role")), True).over(w).alias("speaker"))


_PIECES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(translate(s, chr(10), ' '), '^\s+|\s+$', '', 'g')), lambda s: length(s) > 3)"


@query(f"SELECT doc_id, len(p)::BIGINT AS n, list_sum(list_transform(p, lambda s: length(s)))::BIGINT AS chars FROM (SELECT doc_id, {_PIECES} AS p FROM documents) WHERE len(p) > 0")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).cast("long").alias("chars"))


@query(r"""WITH RECURSIVE k AS (SELECT doc_id, k, trim(regexp_replace(part, '\s+', ' ', 'g')) AS text FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*')) AS part, unnest(range(len(regexp_split_to_array(text, '\n\s*')))) AS k FROM documents)),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ix, length(text) AS n FROM k WHERE text <> ''),
    f AS (SELECT doc_id, ix, n, ix AS first, n AS size, 0 AS chunk FROM p WHERE ix = 0
      UNION ALL SELECT p.doc_id, p.ix, p.n, CASE WHEN f.size + p.n > 1500 THEN f.ix ELSE f.first END, CASE WHEN f.size + p.n > 1500 THEN f.n ELSE f.size END + p.n,
        f.chunk + CASE WHEN f.size + p.n > 1500 THEN 1 ELSE 0 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.ix = f.ix + 1)
    SELECT doc_id, chunk::INT AS chunk_ix, min(first)::INT AS first, max(ix)::INT AS last FROM f GROUP BY doc_id, chunk
    UNION ALL SELECT doc_id, 0, 0, -1 FROM (SELECT DISTINCT doc_id FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id IS NOT DISTINCT FROM d.doc_id)""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return segment.chunks(segment.paragraphs(docs, r"\n\s*").select("doc_id", "para_ix", F.length("text").alias("n")), docs=docs)


_KEY = "regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\.+$', '')"


@query(f"""SELECT doc_id, 's' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS stmt_id, pos, text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY pos) AS nth FROM ({STATEMENTS_SQL})) WHERE nth = 1""")
def text_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.pooled(corpora.phrases(spark, sf_dir))


@query()
def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segment.sentences(table(spark, sf_dir, "documents"))
    return segment.split_statements(s.select("doc_id", F.col("ix").cast("string").alias("stmt_id"), F.col("sentence").alias("text")))


@query(f"SELECT doc_id, pos, CASE WHEN regexp_matches(text, '{cues.INSTANCE.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(text, '{cues.DERIVATION}') THEN 'axiom' ELSE 'derived_claim' END AS type FROM ({STATEMENTS_SQL})")
def retype_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("doc_id", "pos", cues.retyped(F.lit("derived_claim"), F.col("text")).alias("type"))


@query(f"SELECT pos, {cues.cue_sql('text', cues.HEDGE_PHRASES, cues.HEDGE_WORDS)} AS cue FROM ({STATEMENTS_SQL})")
def hedge_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", cues.hedge_cue(F.col("text")).alias("cue"))


@query(f"SELECT pos, {cues.cue_sql('text', cues.DEONTIC_PHRASES, cues.DEONTIC_WORDS)} AS cue FROM ({STATEMENTS_SQL})")
def deontic_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", cues.deontic_cue(F.col("text")).alias("cue"))


@query(f"SELECT pos, {cues.shape_sql('text')} AS shape FROM ({STATEMENTS_SQL})")
def quarantine_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", cues.quarantine_shape(F.col("text")).alias("shape"))


@query(f"SELECT shape, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT {cues.shape_sql('text')} AS shape FROM ({STATEMENTS_SQL})) GROUP BY shape")
def shape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpora.phrases(spark, sf_dir).groupBy(cues.quarantine_shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))
    return n.select("shape", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("pct"))


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark"


@query(f"SELECT word, lemma FROM ({morph.lemma_sql(_WORDS, 'word')})")
def lemma_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", morph.lemma(F.col("word")).alias("lemma"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey < 10 THEN 'x' ELSE 'c' END || p_partkey::VARCHAR WHEN 1 THEN 'c' || p_partkey::VARCHAR || '1'
    WHEN 2 THEN 'c6' || p_partkey::VARCHAR ELSE 'old_ferry' END AS key FROM part""")
def const_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('x', p_partkey) WHEN 1 THEN concat('c', p_partkey, '_1') WHEN 2 THEN concat('six_', p_partkey) ELSE 'Old_Ferry' END")
    return table(spark, sf_dir, "part").select("p_partkey", morph.const_key(name).alias("key"))


_NAMES = "SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN 'Taxation' WHEN 1 THEN 'Taxes' WHEN 2 THEN 'PrimeNumber' WHEN 3 THEN 'Prime' WHEN 4 THEN 'Mortal' ELSE 'Immortal' END AS name FROM orders"
_KEYS = "CASE WHEN name IN ('Taxation', 'Taxes') THEN 'tax' WHEN name IN ('PrimeNumber', 'Prime') THEN 'prime' ELSE lower(name) END"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS pos", "CASE o_orderkey % 6 WHEN 0 THEN 'Taxation' WHEN 1 THEN 'Taxes' WHEN 2 THEN 'PrimeNumber' WHEN 3 THEN 'Prime' WHEN 4 THEN 'Mortal' ELSE 'Immortal' END AS name")


@query(f"SELECT pos, {_KEYS} AS key FROM ({_NAMES})")
def pred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("pos", morph.pred_key(F.col("name")).alias("key"))


@query(f"SELECT doc_id, key, arg_min(CASE name WHEN 'Taxes' THEN 'Tax' ELSE name END, pos) AS display, min(pos) AS first_pos FROM (SELECT *, {_KEYS} AS key FROM ({_NAMES})) GROUP BY doc_id, key")
def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.first_seen(_names(spark, sf_dir)).drop("name")


_DENIALS = ("Mortal", "Immortal", "NotMortal", "Prime", "NonPrimeNumber", "Unfair", "Fair", "NotTaxes", "Taxation", "Indirect", "Direct", "Irregular", "Regular", "Disloyal", "Loyal", "Nonlocal", "Local", "Unit")
_DENIED = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_DENIALS))


@query(f"""WITH n AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS p, CASE (o_orderkey * 7 + o_custkey) % {len(_DENIALS)} {_DENIED} END AS name FROM orders GROUP BY ALL),
    k AS (SELECT *, CASE name WHEN 'NotTaxes' THEN 'nottax' WHEN 'Taxation' THEN 'tax' WHEN 'NonPrimeNumber' THEN 'nonprime' ELSE lower(name) END AS key FROM n),
    v AS (SELECT *, CASE WHEN name = 'NonPrimeNumber' THEN 'primenumb' WHEN name LIKE 'Not%' THEN substr(key, 4) END AS word FROM k),
    w AS (SELECT doc_id, key, p, word AS base, 0 AS rank FROM v WHERE word IS NOT NULL
      UNION ALL SELECT doc_id, key, p, substr(key, length(x) + 1), r FROM v, (VALUES ('non', 1), ('un', 2), ('im', 3), ('ir', 4), ('dis', 5), ('in', 6)) t(x, r) WHERE starts_with(key, x) AND length(key) - length(x) >= 3)
    SELECT w.doc_id, w.key, arg_min(b.key, w.rank) AS base FROM w JOIN k b ON b.doc_id = w.doc_id AND b.key = w.base AND b.p < w.p GROUP BY ALL""")
def negation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS pos", f"CASE (o_orderkey * 7 + o_custkey) % {len(_DENIALS)} {_DENIED} END AS name")
    return vocab.negation_map(vocab.first_seen(names))


_HEADS = "SELECT DISTINCT c_nationkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN 'Fellow' WHEN c_custkey % 7 = 1 AND c_nationkey % 2 = 0 THEN 'FellowOfAcademy' WHEN c_custkey % 7 = 2 AND c_nationkey % 3 = 0 THEN 'FellowOfClub' ELSE 'Voter' END AS name FROM customer"


@query(f"""WITH n AS ({_HEADS}) SELECT doc_id, max(name) FILTER (name LIKE 'FellowOf%') AS old, 'Fellow' AS new FROM n WHERE name LIKE 'Fellow%' GROUP BY doc_id
    HAVING count(*) FILTER (name = 'Fellow') = 1 AND count(*) FILTER (name LIKE 'FellowOf%') = 1""")
def modifier_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "CASE WHEN c_custkey % 7 = 0 THEN 'Fellow' WHEN c_custkey % 7 = 1 AND c_nationkey % 2 = 0 THEN 'FellowOfAcademy' WHEN c_custkey % 7 = 2 AND c_nationkey % 3 = 0 THEN 'FellowOfClub' ELSE 'Voter' END AS name")
    return vocab.modifier_aliases(c)


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS doc_id, CASE WHEN c_custkey % 11 = 0 THEN 'i' WHEN c_custkey % 11 = 1 AND c_nationkey % 2 = 0 THEN 'author' WHEN c_custkey % 11 = 2 THEN 'me' ELSE 'socrates' END AS const FROM customer),
    g AS (SELECT doc_id, CASE WHEN bool_or(const = 'author') THEN 'author' ELSE min(const) END AS new FROM c WHERE const IN ('i', 'author', 'me') GROUP BY doc_id HAVING count(*) > 1)
    SELECT c.doc_id, const AS old, new FROM c JOIN g USING (doc_id) WHERE const IN ('i', 'author', 'me') AND const <> new""")
def self_ref_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "CASE WHEN c_custkey % 11 = 0 THEN 'i' WHEN c_custkey % 11 = 1 AND c_nationkey % 2 = 0 THEN 'author' WHEN c_custkey % 11 = 2 THEN 'me' ELSE 'socrates' END AS const")
    return vocab.self_aliases(c)


_ATOMS = "p_partkey % 50 AS doc_id, p_partkey AS stmt_id, CASE WHEN p_partkey % 3 = 0 THEN 'PrerequisiteFor' WHEN p_partkey % 3 = 1 THEN 'Requires' ELSE 'Loves' END AS pred, 2 AS arity FROM part"


@query(f"""WITH a AS (SELECT {_ATOMS}), n AS (SELECT doc_id, pred, count(DISTINCT stmt_id) AS n, pred = 'PrerequisiteFor' AS flip FROM a WHERE pred <> 'Loves' GROUP BY ALL),
    r AS (SELECT *, first_value(pred) OVER w AS canon FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, flip, pred))
    SELECT doc_id, pred AS old, canon AS new, true AS swap FROM r WHERE pred <> canon""")
def relation_synonym_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.relation_aliases(table(spark, sf_dir, "part").selectExpr(*_ATOMS.removesuffix(" FROM part").split(", ", 2)[:2], _ATOMS.removesuffix(", 2 AS arity FROM part").split(", ", 2)[2], "2 AS arity"))


@query("""WITH f AS (SELECT s_nationkey AS doc_id, s_suppkey AS stmt_id, CASE WHEN s_suppkey % 3 = 0 THEN 'forall x. (Person(x) -> not Ancestor(x, x))' WHEN s_suppkey % 3 = 1 THEN 'Ancestor(a, b)'
    WHEN s_nationkey % 2 = 0 THEN 'Person(adam)' ELSE 'Ancestor(b, c)' END AS fol FROM supplier),
    p AS (SELECT doc_id, bool_or(fol = 'Person(adam)') AS used FROM f GROUP BY doc_id)
    SELECT f.doc_id, stmt_id, CASE WHEN fol LIKE 'forall%' AND NOT used THEN 'forall x. (not Ancestor(x, x))' ELSE fol END AS fol, fol LIKE 'forall%' AND NOT used AS stripped FROM f JOIN p USING (doc_id)""")
def guard_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS doc_id", "s_suppkey AS stmt_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'forall x. (Person(x) -> not Ancestor(x, x))' WHEN s_suppkey % 3 = 1 THEN 'Ancestor(a, b)' WHEN s_nationkey % 2 = 0 THEN 'Person(adam)' ELSE 'Ancestor(b, c)' END AS fol")
    return vocab.strip_guards(f)


# --- translation and admission -----------------------------------------------------------------------------------

_FOL = """CASE event_id % 14 WHEN 9 THEN 'forall x. (User(x) -> InSomeGroup(x))'
  WHEN 10 THEN 'forall x. (User(x) -> Customer(x))' WHEN 11 THEN 'forall x. (Customer(x) -> not Robot(x))'
  WHEN 13 THEN 'Customer(user' || user_id::VARCHAR || ')' END"""


@query(f"SELECT event_id AS pos, {_FOL} AS fol FROM events")
def rule_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", translate.formula(F.col("text")).alias("fol"))


@query(f"""SELECT event_id AS pos, CASE WHEN f IS NOT NULL THEN 'accepted' ELSE 'quarantined' END AS status, CASE WHEN f IS NOT NULL THEN 0.8::DOUBLE END AS confidence,
    CASE WHEN event_id % 14 = 3 THEN 'hedged: typically' WHEN event_id % 14 = 4 THEN 'norm: must' WHEN f IS NULL THEN 'no formula' ELSE 'rules' END AS reason
    FROM (SELECT *, {_FOL} AS f FROM events)""")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpora.phrases(spark, sf_dir).select("doc_id", F.col("pos").alias("stmt_id"), F.lit("axiom").alias("type"), "text")
    return relational.gate(s, guard_deontic=True).select(F.col("stmt_id").alias("pos"), "status", "confidence", "reason")


@query(f"SELECT event_id AS pos, {_FOL} AS fol FROM events WHERE event_id % 14 IN (9, 10, 11, 13)")
def fol_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpora.phrases(spark, sf_dir).select("doc_id", F.col("pos").alias("stmt_id"), translate.formula(F.col("text")).alias("fol")).where("fol is not null")
    good = verdict.parsed(f).where("error is null")
    return good.select(F.col("stmt_id").cast("long").alias("pos"), "fol")


@query("""SELECT p.pred AS pred, 1 AS arity, count(*) AS n FROM events JOIN (VALUES (9, 'User'), (9, 'InSomeGroup'), (10, 'User'), (10, 'Customer+'), (11, 'Customer+'), (11, 'Robot'), (13, 'Customer')) p(k, pred)
    ON event_id % 14 = p.k GROUP BY p.pred""")
def fol_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpora.phrases(spark, sf_dir).select("pos", translate.formula(F.col("text")).alias("fol")).where("fol is not null")
    atoms = f.select("pos", F.posexplode(F.regexp_extract_all("fol", F.lit(r"([A-Z]\w*)\(([^)]*)\)"), F.lit(0))).alias("k", "atom"), F.expr("fol LIKE 'forall%'").alias("rule"))
    pred = F.regexp_extract("atom", r"^(\w+)", 1)
    return atoms.groupBy(F.when(F.col("rule") & (pred == "Customer"), "Customer+").otherwise(pred).alias("pred"), F.size(F.split("atom", ",")).alias("arity")).agg(F.count_distinct("pos").alias("n"))


@query("SELECT doc_id, stmt_id, first FROM (SELECT l_orderkey % 500 AS doc_id, l_orderkey * 10 + l_linenumber AS stmt_id, first_value(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey % 500, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS first FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag) AS nth FROM lineitem) WHERE nth = 1)) WHERE stmt_id <> first")
def alpha_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    v = F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y")
    rows = one.select((F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stmt_id"), F.concat(F.lit("forall "), v, F.lit(". (P"), "flag", F.lit("("), v, F.lit("))")).alias("fol"))
    keys = verdict.parsed(rows.select("fol").distinct().select(F.lit("").alias("doc_id"), F.lit("").alias("stmt_id"), "fol")).select("fol", "alpha")
    return verdict.duplicates(rows.join(keys, "fol").select("doc_id", "stmt_id", F.col("stmt_id").alias("pos"), F.lit("axiom").alias("type"), "alpha")).select("doc_id", "stmt_id", "first")


# --- joins, graphs, verdicts ---------------------------------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z'']+'))"
_IN = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH s AS (SELECT doc_id, pos, {_TOKENS} AS t FROM ({STATEMENTS_SQL})),
    c AS (SELECT doc_id, pos, list_filter(t, lambda w: NOT list_contains({_IN(relational.STOPS + relational.NEGATORS)}, w)) AS c, len(list_intersect(t, {_IN(relational.NEGATORS)})) > 0 AS neg FROM s),
    p AS (SELECT a.doc_id, a.pos AS a, b.pos AS b, a.neg <> b.neg AS opp, len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))) AS j,
      (list_contains(a.c, 'inactive') AND list_contains(b.c, 'active')) OR (list_contains(b.c, 'inactive') AND list_contains(a.c, 'active')) AS ant
      FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE len(a.c) > 0 AND len(b.c) > 0)
    SELECT doc_id, a, b, {rounded_sql("j", 2)} AS jaccard, CASE WHEN opp AND j >= 0.5 THEN 'shared wording with opposite polarity' ELSE 'prefix antonym pair: inactive/active' END AS signal
    FROM p WHERE (opp AND j >= 0.5) OR (ant AND j >= 0.3)""")
def screener_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.screener(corpora.phrases(spark, sf_dir))


@query("""WITH i AS (SELECT conv_id AS doc_id, turn AS ix FROM conversations), p AS (SELECT a.doc_id, a.ix AS a, b.ix AS b, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.ix, b.ix) AS n FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.ix < b.ix)
    SELECT doc_id, a, b FROM p WHERE n <= 7""")
def pairwise_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.capped_pairs(table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS ix"), 7)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey // 8 AS doc_id, l_orderkey AS stmt_id, l_suppkey % 40 AS pred FROM lineitem),
    n AS (SELECT DISTINCT a.doc_id, a.stmt_id AS a, b.stmt_id AS b FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.pred = b.pred),
    r AS (SELECT doc_id, a, b FROM n UNION SELECT r.doc_id, r.a, n.b FROM r JOIN n ON r.doc_id = n.doc_id AND r.b = n.a)
    SELECT doc_id, a AS stmt_id, min(b) AS cluster_id FROM r GROUP BY doc_id, a""")
def clusters_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.components(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 8 AS doc_id", "l_orderkey AS stmt_id", "l_suppkey % 40 AS pred"))


@query(f"WITH RECURSIVE e AS ({REQUIRES_SQL}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def closure_requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.closure(corpora.requires(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({REQUIRES_SQL}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src AS node FROM r WHERE src = dst")
def irreflexive_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cycle_components(corpora.requires(spark, sf_dir)).select("node")


_CONTAINMENT = """SELECT 'c' || c_custkey::VARCHAR AS src, 'n' || c_nationkey::VARCHAR AS dst FROM customer UNION ALL SELECT 's' || s_suppkey::VARCHAR, 'n' || s_nationkey::VARCHAR FROM supplier
    UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation"""


@query(f"WITH RECURSIVE e AS ({_CONTAINMENT}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def closure_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.closure(corpora.containment(spark, sf_dir))


@query("SELECT 'c' || c_custkey::VARCHAR AS src, 'r' || n_regionkey::VARCHAR AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0")
def clash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0")
    n = table(spark, sf_dir, "nation")
    denied = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return relational.closure(corpora.containment(spark, sf_dir)).join(denied, ["src", "dst"], "left_semi")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS inconsistent FROM orders")
def register_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.verdicts(corpora.register(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id, (o_orderkey % 5 + 1)::INT AS round, o_orderkey % 5 + 2 AS denial FROM orders WHERE o_orderstatus = 'F'")
def register_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, rules, denials = relational.register_facts(corpora.register(spark, sf_dir))
    return relational.clashes(relational.saturate(facts, rules), denials).select("doc_id", "round", F.col("denial").cast("long").alias("denial"))


_SCORED = "SELECT o_orderkey % 5 + 1 AS hops, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expected, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_totalprice > 200000 OR o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS found FROM orders"
_CONFUSION = "count(*) FILTER (expected = 1 AND found = 1) AS tp, count(*) FILTER (expected = 0 AND found = 1) AS fp, count(*) FILTER (expected = 1 AND found = 0) AS fn, count(*) FILTER (expected = 0 AND found = 0) AS tn, count(*) FILTER (found IS NULL) AS errors"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey % 5 + 1 AS hops", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expected", "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_totalprice > 200000 OR o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS found", "o_orderpriority AS system", "o_orderstatus AS dataset")


@query(f"SELECT {_CONFUSION} FROM ({_SCORED})")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.confusion(_scored(spark, sf_dir))


_W = lambda k, n: f"({k}::DOUBLE / {n})"
_MID = "((tp::DOUBLE / (tp + fn) + 3.8416 / (2 * (tp + fn))) / (1 + 3.8416 / (tp + fn)))"
_HALF = "(1.96 * sqrt(tp::DOUBLE / (tp + fn) * (1 - tp::DOUBLE / (tp + fn)) / (tp + fn) + 3.8416 / (4.0 * (tp + fn) * (tp + fn))) / (1 + 3.8416 / (tp + fn)))"


@query(f"""SELECT hops, round({_W('tp', '(tp + fn)')}, 9) AS recall, round(greatest(0, {_MID} - {_HALF}), 9) AS recall_low, round(least(1, {_MID} + {_HALF}), 9) AS recall_high, round({_W('fp', '(fp + tn)')}, 9) AS fpr,
    round({_W('tp', '(tp + fp)')}, 9) AS precision, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM (SELECT hops, {_CONFUSION} FROM ({_SCORED}) GROUP BY hops)""")
def wilson_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = relational.metrics(relational.confusion(_scored(spark, sf_dir), "hops"), "hops")
    return m.select("hops", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query(f"SELECT hops, count(*) FILTER (found = 1) AS found, count(*) AS n FROM ({_SCORED}) WHERE expected = 1 GROUP BY GROUPING SETS ((hops), ())")
def recall_by_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("expected = 1").groupingSets([["hops"], []], "hops").agg(F.count_if(F.col("found") == 1).alias("found"), F.count("*").alias("n"))


@query(f"SELECT system, count(*) FILTER (found = 1 AND dataset = 'F') AS f, count(*) FILTER (found = 1 AND dataset = 'O') AS o, count(*) FILTER (found = 1 AND dataset = 'P') AS p FROM ({_SCORED.replace(' FROM orders', ', o_orderpriority AS system, o_orderstatus AS dataset FROM orders')}) GROUP BY system")
def system_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scored(spark, sf_dir).groupBy("system").pivot("dataset", ["F", "O", "P"]).agg(F.count_if(F.col("found") == 1))
    return p.select("system", *[F.coalesce(c, F.lit(0).cast("long")).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT 'k' || (event_id % 50)::VARCHAR AS key, arg_max('f' || event_id::VARCHAR, event_id) AS fol FROM events WHERE event_id % 10 <> 9 GROUP BY 1")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""concat('{"key": "k', event_id % 50, '", "fol": "f', event_id, if(event_id % 10 = 9, '"', '"}'))""")
    return corpora.latest_checkpoint(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("value")))


@query("SELECT doc_id, doc_id::VARCHAR || '|' || substr(sha1(text), 1, 12) AS key FROM documents")
def translation_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", corpora.cache_key(F.col("doc_id"), F.col("text")).alias("key"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 60)::DOUBLE WHEN 1 THEN (event_id % 5) * 60.0 + event_id % 60 + 0.5 END AS seconds FROM events")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 3 WHEN 0 THEN string(event_id % 60) WHEN 1 THEN concat(event_id % 5, 'm', event_id % 60, '.5s') ELSE 'soon' END")
    return table(spark, sf_dir, "events").select("event_id", corpora.retry_after(text).alias("seconds"))


@query(f"""SELECT event_id AS pos, CASE WHEN event_id % 14 IN (0, 2, 3, 8) THEN regexp_replace(text, ' is (.*)\\.', ' is not \\1.') WHEN event_id % 14 IN (9, 12, 13) THEN regexp_replace(text, ' is (.*)\\.', ' is not \\1.') WHEN event_id % 14 = 11 THEN 'No customer is not a robot.' WHEN event_id % 14 = 1 THEN replace(text, ' is not ', ' is ') END AS denial
    FROM (SELECT event_id, text FROM events JOIN ({STATEMENTS_SQL}) ON pos = event_id)""")
def sentence_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.phrases(spark, sf_dir).select("pos", translate.negation(F.col("text")).alias("denial"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'contradicts' ELSE NULL END AS verdict, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 + 3 ELSE 0 END AS size FROM orders")
def general_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register again, by the general layer: the verdict of each denial and the size of its minimal conflict."""
    s = corpora.register(spark, sf_dir)
    props = s.select("doc_id", F.col("pos").cast("string").alias("stmt_id"), "pos", F.lit("axiom").alias("type"), translate.formula(F.col("text")).alias("fol"))
    out = verdict.verified(props)
    last = out.groupBy("doc_id").agg(F.max_by(F.struct("verdict", "conflict"), F.col("stmt_id").cast("int")).alias("v"))
    return last.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v.verdict").alias("verdict"), F.when(F.col("v.verdict").isNotNull(), F.size("v.conflict") + 1).otherwise(0).cast("long").alias("size"))


@query()
def theory_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpora.register(spark, sf_dir)
    props = translate.read(s).select("doc_id", F.col("pos").cast("string").alias("stmt_id"), "pos", F.lit("axiom").alias("type"), translate.written(F.col("p")).alias("fol"))
    return verdict.theories(props)


from . import chains, corpus, formulas  # noqa: E402, F401  register their queries
