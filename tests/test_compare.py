"""Circles, differences of runs, balanced cells, options as columns."""

import random
from collections import Counter

from pyspark.sql import functions as F

from prooflake.operators import admission, compare, graphs


def test_circles_equal_reachability(spark):
    r = random.Random(4)
    for n, m in ((12, 14), (20, 30), (6, 20)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100, 100), (None, 1), (101, 102)]
        edges += edges[:3]
        reach = {(a, b) for a, b in edges if a is not None}
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        want = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if (a, a) in reach}
        got = graphs.cycle_components(spark.createDataFrame(edges, "src long, dst long")).collect()
        assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert graphs.cycle_components(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def test_changes_and_missing(spark):
    schema = "doc_id string, stmt_id string, status string, verdict string"
    a = spark.createDataFrame([("d", "a", "accepted", None), ("d", "b", "accepted", "entailed"), ("d", "c", "quarantined", None), ("e", "a", "accepted", None)], schema)
    b = spark.createDataFrame([("d", "a", "accepted", None), ("d", "b", "accepted", "not_entailed"), ("d", "x", "quarantined", None), ("f", "a", "accepted", None)], schema)
    got = {x.doc_id: tuple(x)[1:] for x in compare.changes(a, b).collect()}
    assert got == {"d": (2 / 3, 2 / 3, 1, 1, 1), "e": (1.0, None, 0, 1, 0), "f": (None, 1.0, 0, 0, 1)}
    planted = compare.missing(a, b, "doc_id")
    assert [x.doc_id for x in planted.collect()] == ["e"]


def test_balanced_cells_are_exact(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 5000, "big").when(F.col("id") < 5990, F.lit(None)).otherwise("small").alias("cell"))
    key = F.md5(F.col("id").cast("string").cast("binary"))
    got = compare.balanced(rows, 300, "cell", key=key).collect()
    assert Counter(r.cell for r in got) == {"big": 300, None: 300, "small": 10} and len({r.id for r in got}) == 610
    assert sorted(r.id for r in got) == sorted(r.id for r in compare.balanced(rows.repartition(7), 300, "cell", key=key).collect())


def test_entailment_items(spark):
    rows = [(1, "Tom is a cat.", "Tom is a pet.", "True"), (2, "Tom is a cat.", "Tom is a dog.", "Unknown"), (3, "x", "Tom is a dog.", "False"), (4, "x", "no form", "True")]
    got = compare.consistency(spark.createDataFrame(rows, "doc_id int, text string, conclusion string, label string")).collect()
    assert {(r.doc_id, r.text, r.expected) for r in got} == {(1, "Tom is a cat. Tom is not a pet.", 1), (2, "Tom is a cat. Tom is not a dog.", 0)}


def test_options_as_columns_equal_separate_runs(spark):
    rows = [(str(d), str(i), i, "axiom", text, rule, other) for d in range(2) for i, (text, rule, other) in enumerate([
        ("Users must pay.", None, "forall x. (MustPay(x) -> Pay(x))"), ("Tom likes Ann.", "Likes(tom)", "Likes(tom, ann)"), ("Tom is a cat.", "Cat(tom)", None),
    ])]
    df = spark.createDataFrame(rows, "doc_id string, stmt_id string, pos int, type string, text string, rule string, other string")
    fields = ("doc_id", "stmt_id", "status", "reason", "fol")
    pick = lambda x: {tuple(r[f] for f in fields) for r in x.collect()}
    mixed = df.withColumn("guard_deontic", F.col("doc_id") == "1").withColumn("allow_relations", F.when(F.col("doc_id") == "1", True))
    want = pick(admission.gate(df.where("doc_id = '0'"))) | pick(admission.gate(df.where("doc_id = '1'"), True, True))
    assert pick(admission.gate(mixed)) == want
