"""Registered queries of runs over documents: statements with lineage and spans, outlines, candidates, run differences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import span
from ..operators import admission, compare, corpus, graphs, relational, theory, translate
from ..operators.runtime import cut, shared
from ..sources import corpora
from ..sources.corpora import REQUIRES_SQL, STATEMENTS_SQL, table
from ..streaming import statements as streaming
from .catalog import _FOL, _IN, _TOKENS, query


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each conversation: its turns, a paragraph each, and what an extractor would return for them."""
    turn = F.struct("turn", F.regexp_replace("text", r"\s+", " ").alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    found = F.transform("t", lambda x: F.struct(F.concat(F.lit("t"), x["turn"].cast("string")).alias("id"), F.lit("axiom").alias("type"), x["text"].alias("original_text")))
    return c.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("raw_text"), F.to_json(found).alias("extraction"))


_TURNS = """t AS (SELECT conv_id::VARCHAR AS doc_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations),
    d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS raw FROM t GROUP BY doc_id)"""


@query(f"""WITH {_TURNS}, s AS (SELECT doc_id, turn, text, raw, length(raw) >= 2000 AS long, regexp_replace(trim(lower(text)), '\\.+$', '') AS key FROM t JOIN d USING (doc_id) WHERE trim(text) <> ''),
    f AS (SELECT *, min(turn) OVER (PARTITION BY doc_id, key) AS first FROM s),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM f)
    SELECT doc_id, 't' || turn AS source_id, CASE WHEN long THEN 's' || k ELSE 't' || turn END AS stmt_id, strpos(raw, text)::INT - 1 AS start, strpos(raw, text)::INT - 1 + length(text)::INT AS stop FROM n""")
def statement_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _talks(spark, sf_dir)
    s, lineage = corpus.statements(docs, corpus.chunked(docs))
    said = corpus.extraction.statements(docs.select("doc_id", F.col("extraction").alias("raw"))).select("doc_id", F.col("stmt_id").alias("source_id"), "original_text")
    met = lineage.join(said, ["doc_id", "source_id"]).join(docs.select("doc_id", "raw_text"), "doc_id")
    at = span(F.col("raw_text"), F.col("original_text"))
    return met.select("doc_id", "source_id", "stmt_id", at["start"].alias("start"), at["end"].alias("stop"))


@query(f"""WITH RECURSIVE {_TURNS}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS k, length(trim(text)) AS n FROM t WHERE trim(text) <> ''),
    l AS (SELECT doc_id FROM d WHERE length(raw) >= 2000),
    r AS (SELECT doc_id, 1::BIGINT AS k, n, 1 AS chunk, n AS size, n AS last FROM p JOIN l USING (doc_id) WHERE k = 1
      UNION ALL SELECT r.doc_id, p.k, p.n, CASE WHEN r.size + p.n > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + p.n > 1500 THEN r.last + p.n ELSE r.size + p.n END, p.n
      FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
    SELECT doc_id, coalesce(max(chunk), 1)::BIGINT AS n_chunks FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def chunk_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunked(_talks(spark, sf_dir)).select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS node FROM lineitem),
    e AS (SELECT a.doc_id, a.node, b.node AS part, row_number() OVER (PARTITION BY a.doc_id, a.node ORDER BY b.node) AS place FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.node - a.node IN (1, 2)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node) AS k FROM n),
    p AS (SELECT doc_id, node, [k] AS path FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = o.doc_id AND e.part = o.node)
      UNION ALL SELECT e.doc_id, e.part, list_append(p.path, e.place) FROM p JOIN e ON p.doc_id = e.doc_id AND p.node = e.node),
    f AS (SELECT doc_id, node, min(path) AS own FROM p GROUP BY doc_id, node),
    l AS (SELECT p.doc_id, p.node, p.path, f.own FROM p JOIN f ON p.doc_id = f.doc_id AND p.node = f.node
      WHERE len(p.path) = 1 OR EXISTS (SELECT 1 FROM f g WHERE g.doc_id = p.doc_id AND g.own = list_slice(p.path, 1, len(p.path) - 1)))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path)::INT AS line, (len(path) - 1)::INT AS depth, node::VARCHAR AS node,
           path <> own AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = l.doc_id AND e.node = l.node) AS above FROM l""")
def theory_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("node"), F.col("l_linenumber").alias("pos"))
    e = n.select("doc_id", "node", F.explode(F.array(F.col("node") + 1, F.col("node") + 2)).alias("part"))
    return theory.outline(n, e).withColumn("node", F.col("node").cast("string"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, text, {_TOKENS} AS t FROM ({STATEMENTS_SQL})),
    c AS (SELECT doc_id, text, list_filter(t, lambda w: NOT list_contains({_IN(relational.STOPS + relational.NEGATORS)}, w)) AS c, len(list_intersect(t, {_IN(relational.NEGATORS)})) > 0 AS neg FROM s),
    w AS (SELECT doc_id, text, c, neg, unnest(c) AS w FROM c), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT doc_id, text, c, neg, w, row_number() OVER (PARTITION BY doc_id, text ORDER BY n, w) AS k, len(c) AS s FROM w JOIN n USING (doc_id, w)),
    i AS (SELECT *, k <= s - ceil(s * 0.5) + 1 AS half, k <= s - ceil(s * 0.3) + 1 AS third FROM r),
    p AS (SELECT DISTINCT a.doc_id, least(a.text, b.text) AS ta, greatest(a.text, b.text) AS tb FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.w = b.w AND a.text <> b.text
      WHERE (a.neg AND NOT b.neg AND a.half AND b.half AND a.s >= 0.5 * b.s AND b.s >= 0.5 * a.s)
         OR (a.third AND b.third AND a.s >= 0.3 * b.s AND b.s >= 0.3 * a.s AND len(list_filter(a.c, lambda u: len(list_filter({_IN(relational.NEGATIVE_PREFIXES)}, lambda q: starts_with(u, q) AND length(u) - length(q) >= 3 AND list_contains(b.c, substr(u, length(q) + 1)))) > 0)) > 0))
    SELECT doc_id, count(*) AS candidates FROM p GROUP BY doc_id""")
def screener_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.candidate_pairs(corpora.phrases(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("candidates"))


@query("""WITH s AS (SELECT user_id::VARCHAR AS doc_id, event_id, text, regexp_replace(trim(lower(text)), '\\.+$', '') AS key FROM events JOIN ("""
       + f"SELECT pos, text FROM ({STATEMENTS_SQL})" + """) ON pos = event_id),
    f AS (SELECT doc_id, key, min(event_id) AS place, min_by(text, event_id) AS text FROM s GROUP BY doc_id, key)
    SELECT doc_id, 's' || row_number() OVER (PARTITION BY doc_id ORDER BY place) AS stmt_id, place AS chunk_ix, text FROM f""")
def stream_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents, events as their chunks, streamed in three batches in order of events."""
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    said = corpora.phrases(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").alias("chunk_ix"), F.to_json(F.array("text")).alias("raw"))
    for k, part in enumerate(("chunk_ix < 3000", "chunk_ix >= 3000 AND chunk_ix < 3001", "chunk_ix >= 3001")):
        said.where(part).write.parquet(f"{at}/in/batch={k}")
        chunks = spark.readStream.schema("doc_id string, chunk_ix long, raw string").parquet(f"{at}/in/*")
        streaming.stream_statements(chunks, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(streaming.OUT).parquet(f"{at}/out").select("doc_id", "stmt_id", "chunk_ix", "text")


@query(f"""WITH RECURSIVE e AS ({REQUIRES_SQL}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def cycle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cycle_components(corpora.requires(spark, sf_dir))


_MUST = "CASE WHEN event_id % 14 = 4 THEN 'forall x. (MustPay(x) -> Pay(x))' END"


@query(f"""WITH s AS (SELECT user_id AS doc_id, event_id % 14 = 4 AS norm, event_id % 14 NOT IN (3, 4) AND {_FOL} IS NOT NULL AS plain FROM events)
    SELECT doc_id, avg((plain OR norm)::INT) AS accepted_before, avg(plain::INT) AS accepted_after, count(*) FILTER (norm) AS changed, 0::BIGINT AS only_before, 0::BIGINT AS only_after FROM s GROUP BY doc_id""")
def guard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate without and with its guard against norms, both in one plan by a column, statement by statement."""
    said = corpora.phrases(spark, sf_dir).withColumn("event_id", F.col("pos"))
    both = said.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("guard_deontic"), "doc_id", "pos", "text", F.expr(_MUST).alias("other"))
    both = both.select("guard_deontic", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("guard_deontic").cast("string")).alias("doc_id"), F.col("pos").alias("stmt_id"), "pos", F.lit("axiom").alias("type"), "text", translate.formula(F.col("text")).alias("rule"), "other")
    g = cut(admission.gate(cut(both)).select(F.split("doc_id", " ").alias("d"), "stmt_id", "status", F.lit(None).cast("string").alias("verdict")))
    side = lambda flag: g.where(F.get("d", F.lit(1)) == flag).select(F.get("d", F.lit(0)).cast("long").alias("doc_id"), "stmt_id", "status", "verdict")
    return compare.changes(side("false"), side("true"))


_ITEMS = """SELECT o_orderkey AS doc_id, o_orderkey % 5 + 1 AS hops, concat('Item', o_orderkey, ' is new.') AS text, concat('Item', o_orderkey, ' is sold.') AS conclusion,
    CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'Unknown' ELSE 'False' END AS label FROM {orders}"""


@query(f"""WITH c AS (SELECT doc_id, hops, CASE label WHEN 'True' THEN 1 ELSE 0 END AS expected, concat(text, ' ', replace(conclusion, ' is ', ' is not ')) AS text FROM ({_ITEMS.format(orders='orders')}) WHERE label <> 'False'),
    r AS (SELECT *, row_number() OVER (PARTITION BY hops, expected ORDER BY md5(concat('7 ', doc_id))) AS nth FROM c) SELECT doc_id, hops, expected, text FROM r WHERE nth <= 40""")
def balanced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(_ITEMS, orders=table(spark, sf_dir, "orders"))
    return compare.balanced(compare.consistency(items), 40, "hops", "expected", key=F.md5(F.concat(F.lit("7 "), F.col("doc_id").cast("string")).cast("binary")))


@query("""WITH m AS (SELECT DISTINCT o_orderpriority AS system, o_orderstatus AS dataset, o_orderkey AS doc_id FROM orders)
    SELECT system, dataset, count(*) AS absent FROM m WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_returnflag = 'R') GROUP BY ALL""")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the manifest's runs; a run took place where a line of the order was returned."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("doc_id"))
    ran = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return compare.missing(o, o.join(ran, "doc_id"), "system", "dataset", "doc_id").groupBy("system", "dataset").agg(F.count("*").alias("absent"))
