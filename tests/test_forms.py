"""Statements worked out once for what are equal up to their number, against each worked out on its own."""

from pyspark.sql import functions as F

from prooflake.operators import admission, forms, run

SCHEMA = "doc_id int, stmt_id string, pos int, type string, text string, other string"


def ledger(spark, docs):
    make = lambda d: [("axiom", "Every buyer is a payer.", None), ("axiom", f"C1{d} is a buyer.", f"Buyers(c1_{d})"), ("axiom", f"C1{d} is a buyer.", None), ("derived_claim", f"C1{d} is a payer.", f"Payer(c1_{d})")]
    return spark.createDataFrame([(d, f"s{k}", k, *row) for d in docs for k, row in enumerate(make(d))], SCHEMA)


def test_a_form_is_decided_once(spark, monkeypatch):
    asked, real = [], admission.decided
    monkeypatch.setattr(admission, "decided", lambda s, *a: asked.append(s.count()) or real(s, *a))
    got = run.run(ledger(spark, range(10, 40))).collect()
    assert asked == [4] and len(got) == 120
    assert {(r.stmt_id, r.fol) for r in got if r.doc_id == "17"} == {("s0", "forall x. (Buyer(x) -> Payer(x))"), ("s1", "Buyer(c117)"), ("s2", "Buyer(c117)"), ("s3", "Payer(c117)")}
    assert {(r.first, r.verdict, tuple(r.support or ())) for r in got if r.stmt_id in ("s2", "s3")} == {("s1", None, ()), (None, "entailed", ("s0", "s1"))}


def test_forms_and_rows_agree(spark, monkeypatch):
    said = [("One5 is a b52.", "B52(one5)"), ("C12 is a cat.", "Cats(c_13)"), ("Item 12 needs item 12.", "Needs(c12, c12)"), ("Item 1 is in group 2.", "InGroup(c1, c2)"), ("Tom is a b52.", None), ("Tom is a b53.", "B99(tom)"), ("C12 is a cat.", "Cat(c1_2)"),
            ("C1 owns body.", "RightToBody(c1)"), ("C1 is a body right.", "RightToBody(c1)"), ("C13 owns body.", "RightToBody(c1_3)"), ("C7 is a cat.", "Cat(C7"), ("", "Cat(tom)"), (None, None), ("C12 is not a cat.", "not Cat(c12)")]
    df = spark.createDataFrame([(d, f"s{k}", k, "axiom", t, o) for d in (1, 2) for k, (t, o) in enumerate(said[:: 3 - 2 * d])], SCHEMA)
    rows = lambda: sorted(str(r.asDict()) for r in run.run(df).collect())
    some = rows()
    monkeypatch.setattr(forms, "FORMS", 0)
    monkeypatch.setattr(forms, "number", lambda *texts: F.lit(None).cast("string"))
    assert rows() == some


def test_number(spark):
    texts = [("a1", "b1"), ("a1", "b11"), ("a", None), ("12 12", "c12d"), ("1_2", None)]
    df = spark.createDataFrame(texts, "a string, b string").withColumn("n", forms.number(F.col("a"), F.col("b")))
    assert [r.n for r in df.collect()] == ["1", None, "", "12", None]
    assert [r[0] for r in df.select(forms.told(forms.masked(F.col("a")), F.col("n"))).collect()] == ["a1", "a9", "a", "12 12", "9_9"]
