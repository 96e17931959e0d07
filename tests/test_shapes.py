"""Documents worked out by shape against each worked out on its own, and sentences read by form."""

from pyspark.sql import functions as F

from prooflake.operators import horn, runtime, shapes, translate, verdict

SCHEMA = "doc_id string, stmt_id string, pos int, type string, fol string"


def props(spark):
    make = lambda a, b: [f"P({a})", f"R({a}, {b})", "forall x, y. (P(x) and R(x, y) -> Q(y))", f"not Q({b})", f"not Q({a})"]
    names = [("ann", "bob"), ("cy", "dee"), ("dee", "cy"), ("a", "ab"), ("ab", "a"), ("Zed", "amy"), ("_u", "v"), ("x", "y"), ("ö", "z"), ("z", "z")]
    docs = {f"d{i}": make(a, b) for i, (a, b) in enumerate(names)} | {"bad": [None, "P(", "P(a)"], "long": make("k", "m") + [f"P(n{i})" for i in range(70)]}
    return spark.createDataFrame([(d, f"s{i}", i, "axiom", f) for d, fs in docs.items() for i, f in enumerate(fs)], SCHEMA)


def test_shapes(spark):
    at = {r.doc_id: r.shape for r in shapes.of_formulas(props(spark), "stmt_id").collect()}
    assert at["d0"] == at["d1"] == at["d3"] and at["d2"] == at["d4"] != at["d0"] and at["d5"] != at["d0"]
    assert {d for d, s in at.items() if s.startswith("doc ")} == {"d6", "d8", "long"}


def test_refuted(spark):
    p = props(spark)
    rows = lambda df: sorted((r.doc_id, r.neg, r.pred, r.args, r.lit, r.round, r.stmt_id, r.premises) for r in df.collect())
    want = rows(horn.refutations(horn.saturate(p)))
    assert {r[0] for r in want} == {f"d{i}" for i in range(10)} | {"long"} and rows(horn.refuted(p)) == want


def test_theories(spark):
    p = props(spark)
    v = verdict.verified(p).join(p.select("doc_id", "stmt_id", "pos", "type"), ["doc_id", "stmt_id"])
    want = sorted(map(tuple, verdict.reports(v).select("doc_id", "tree", "dot", "markdown").collect()))
    assert sorted(map(tuple, verdict.theories(p).collect())) == want


def test_read(spark):
    texts = [None, "", "Bob is a cat.", "bob was not an old dog!", "There is a cat", "No is a cat.", "Who is a cat.", "Every cat is a pet.", "No cat is a dog.", "Ann is who she is.", "b_c is not red.", "Not is a non red cat.", "Everyone is a cat.", "Some cats are pets.", "Bob  is a cat", "A1 is a if."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = rows.select("i", translate.parts(F.col("text")).alias("p")).collect()
    assert sorted(translate.read(rows).select("i", "p").collect()) == sorted(want)


def test_dealt(spark, monkeypatch):
    """More rows are dealt to more tasks, not to larger ones; documents of too many rows are told apart."""
    monkeypatch.setattr(runtime, "TASK_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") % 100).alias("doc_id"), "id")
    small, large = shapes.dealt(rows, 10)
    assert small.rdd.getNumPartitions() >= 20 and small.count() == 1000 and large is None
    small, large = shapes.dealt(rows.unionByName(spark.createDataFrame([(7, 1), (None, 2)], "doc_id long, id long")), 10)
    assert small.count() == 991 and [r.doc_id for r in large.collect()] == [7]
    assert shapes.dealt(rows.limit(0), 10)[0].count() == 0
