"""Queries over relational forward chaining, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import horn, translate
from ..sources import corpora
from ..sources.corpora import table
from .catalog import query

_TRANSITIVE = "forall x, y, z. (LocatedIn(x, y) and LocatedIn(y, z) -> LocatedIn(x, z))"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation: its customers and suppliers are in it, it is in its region, location is transitive, and
    every seventh customer is said not to be in the region."""
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    rule = nation.selectExpr("n_nationkey AS doc_id", "'rule' AS stmt_id", "0 AS pos", f"'{_TRANSITIVE}' AS fol")
    region = nation.selectExpr("n_nationkey AS doc_id", "'nation' AS stmt_id", "1 AS pos", "concat('LocatedIn(n', n_nationkey, ', r', n_regionkey, ')') AS fol")
    people = customer.selectExpr("c_nationkey AS doc_id", "concat('c', c_custkey) AS stmt_id", "2 AS pos", "concat('LocatedIn(c', c_custkey, ', n', c_nationkey, ')') AS fol")
    sellers = supplier.selectExpr("s_nationkey AS doc_id", "concat('s', s_suppkey) AS stmt_id", "3 AS pos", "concat('LocatedIn(s', s_suppkey, ', n', s_nationkey, ')') AS fol")
    denied = customer.where("c_custkey % 7 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    denied = denied.selectExpr("c_nationkey AS doc_id", "concat('d', c_custkey) AS stmt_id", "4 AS pos", "concat('not LocatedIn(c', c_custkey, ', r', n_regionkey, ')') AS fol")
    return rule.unionByName(region).unionByName(people).unionByName(sellers).unionByName(denied)


@query("""WITH m AS (SELECT c_nationkey AS k, 'c' || c_custkey::VARCHAR AS who FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey::VARCHAR FROM supplier)
    SELECT k::INT AS doc_id, false AS neg, 'LocatedIn(' || who || ', n' || k::VARCHAR || ')' AS lit, 0 AS round, who AS stmt_id, '' AS premises FROM m
    UNION ALL SELECT n_nationkey::INT, false, 'LocatedIn(n' || n_nationkey::VARCHAR || ', r' || n_regionkey::VARCHAR || ')', 0, 'nation', '' FROM nation
    UNION ALL SELECT k::INT, false, 'LocatedIn(' || who || ', r' || n_regionkey::VARCHAR || ')', 1, 'rule', 'LocatedIn(' || who || ', n' || k::VARCHAR || '); LocatedIn(n' || k::VARCHAR || ', r' || n_regionkey::VARCHAR || ')' FROM m JOIN nation ON k = n_nationkey
    UNION ALL SELECT c_nationkey::INT, true, 'LocatedIn(c' || c_custkey::VARCHAR || ', r' || n_regionkey::VARCHAR || ')', 0, 'd' || c_custkey::VARCHAR, '' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0""")
def horn_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horn.saturate(_places(spark, sf_dir), stop_at_clash=False)
    return out.select(F.col("doc_id").cast("int").alias("doc_id"), "neg", "lit", "round", "stmt_id", F.array_join("premises", "; ").alias("premises"))


def _register_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpora.register(spark, sf_dir)
    return horn.refuted(translate.read(s).select("doc_id", F.col("pos").alias("stmt_id"), "pos", translate.written(F.col("p")).alias("fol")))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 5 + 3 AS steps, (o_orderkey % 5 + 1)::INT AS last_round, o_orderkey % 5 + 1 AS premises FROM orders WHERE o_orderstatus = 'F'")
def horn_refutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _register_steps(spark, sf_dir)
    out = steps.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return out.agg(F.count("*").alias("steps"), F.max("round").alias("last_round"), F.sum(F.size("premises")).cast("long").alias("premises"))


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 5 + 3 AS lines, 'Rung0(item' || o_orderkey::VARCHAR || ')  [' || (o_orderkey % 5 + 1)::VARCHAR || ']' AS first_line FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 > 0
    UNION ALL SELECT o_orderkey, 3, 'Rung0(item' || o_orderkey::VARCHAR || ')  [1]' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0""")
def horn_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return horn.proofs(_register_steps(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("lines"), lines[0].alias("first_line"))
