from prooflake.operators import run, segment

SCHEMA = "doc_id int, stmt_id string, pos int, type string, text string, other string"


def test_run(spark):
    rows = [
        (1, "a", 1, "axiom", "Every human is mortal.", "forall y. (Humans(y) -> Mortal(y))"), (1, "b", 2, "axiom", "Socrates is a human.", None), (1, "c", 3, "axiom", "Socrates is a human.", None),
        (1, "d", 4, "derived_claim", "Socrates is mortal.", None), (1, "e", 5, "axiom", "Plato is immortal.", "Immortal(plato)"), (1, "f", 6, "axiom", "Birds typically fly.", "Fly(birds)"),
        (2, "a", 1, "axiom", "Tom is a cat.", None), (2, "b", 2, "axiom", "Tom is not a cat.", None), (3, "a", 1, "axiom", None, None),
    ]
    extra = spark.createDataFrame([(1, "p", "forall x. (Mortal(x) -> Being(x))", None), (1, "q", "Bad((", "a gloss")], "doc_id int, stmt_id string, fol string, gloss string")
    got = {(r.doc_id, r.stmt_id): r for r in run.run(spark.createDataFrame(rows, SCHEMA), extra).collect()}
    assert len(got) == 11
    assert got["1", "a"].reason == "agreed" and got["1", "c"].first == "b" and got["1", "c"].verdict is None
    assert got["1", "d"].verdict == "entailed" and sorted(got["1", "d"].support) == ["a", "b"]
    assert got["1", "e"].fol == "not Mortal(plato)" and got["1", "f"].reason == "hedged"
    assert got["1", "p"].status == "accepted" and got["1", "p"].type == "bridge" and got["1", "q"].status == "quarantined" and got["1", "q"].text == "a gloss"
    assert {got["2", i].verdict for i in "ab"} == {"contradicts"} and got["2", "a"].conflict == ["b"] and got["3", "a"].status == "quarantined"


def test_original_words_are_guarded(spark):
    s = spark.createDataFrame([(1, "a", 1, "axiom", "Tom is a cat.", None, "Tom is typically a cat.")], SCHEMA + ", original string")
    assert run.run(s).first().reason == "hedged"


def test_normalised_constants_meet(spark):
    rows = [(1, "a", 1, "Require(c65060, c61060)"), (1, "b", 2, "Requires(c6_5060, c6_100a)"), (1, "c", 3, "forall c6_1. (Require(c6_1, c6_1) -> not Unmet(c6_1))"), (2, "a", 1, None)]
    df = spark.createDataFrame(rows, "doc_id int, stmt_id string, pos int, fol string")
    got = {(r.doc_id, r.stmt_id): r.fol for r in run.normalised(df, "stmt_id").collect()}
    assert got[1, "b"] == "Require(c65060, c6100a)" and got[1, "c"] == rows[2][3] and got[2, "a"] is None


def test_empty(spark):
    assert run.run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_titled_sentences(spark):
    docs = spark.createDataFrame([(1, "  Title.\nIt is 3.5 m\nlong. Yes! Ok"), (2, None)], "doc_id int, text string")
    assert [r.sentence for r in segment.sentences(docs, titled=True).orderBy("ix").collect()] == ["It is 3.5 m long.", "Yes!"]


def test_set_aside_statements_show_no_names(spark):
    rows = [(1, "a", 1, "axiom", "Plato is typically mortal.", "Mortal(plato)"), (1, "b", 2, "axiom", "Zeus is immortal.", "Immortal(zeus)"), (2, "a", 1, "rhetorical", "Who is mortal?", "Mortal(plato)"), (2, "b", 2, "axiom", "Zeus is immortal.", "Immortal(zeus)")]
    got = {(r.doc_id, r.stmt_id): r for r in run.run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["1", "a"].reason == "hedged" and got["1", "b"].fol == got["2", "b"].fol == "Immortal(zeus)"


def test_a_statements_own_formula_shows_its_names_first(spark):
    rows = [(1, "a", 1, "axiom", "Tom is a cat.", "Cats(tom)"), (1, "b", 2, "axiom", "Zeus is immortal.", "Immortal(zeus)")]
    got = {r.stmt_id: r.fol for r in run.run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"] == "Cat(tom)"


def test_rounding_by_the_exact_value(spark):
    from pyspark.sql import functions as F

    from prooflake.functions.numbers import rounded, rounded_sql

    pairs = [(i, u) for u in range(1, 210) for i in range(u + 1) if i / u >= 0.008 or i == 0]
    df = spark.createDataFrame(pairs, "i int, u int").withColumn("x", F.col("i") / F.col("u"))
    got = df.select("i", "u", rounded(F.col("x"), 2).alias("two"), rounded(F.col("x"), 3).alias("three")).collect()
    assert [(r.two, r.three) for r in got] == [(round(r.i / r.u, 2), round(r.i / r.u, 3)) for r in got]
    import duckdb

    for i, u in ((23, 40), (7, 40), (21, 40), (1, 8), (3, 8)):
        assert duckdb.sql(f"SELECT {rounded_sql(f'{i}::DOUBLE / {u}', 2)}").fetchall() == [(round(i / u, 2),)]
