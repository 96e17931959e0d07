from pyspark.sql import functions as F

from prooflake.operators import admission

SCHEMA = "doc_id int, stmt_id string, pos int, type string, text string, rule string, other string"


def test_gate(spark):
    every = "Every cat is an animal."
    cases = [
        ("rhetorical", every, "A(x)", None, "type", None), ("axiom", "Cats typically purr.", "A(x)", None, "hedged", None),
        ("axiom", "Cats purr.", None, "P((", "no formula", None),
        ("axiom", every, "forall x. (Cat(x) -> Animal(x))", "forall y. (not Animal(y) -> not Cat(y))", "agreed", 0.95),
        ("axiom", every, "forall x. (Cat(x) -> Animal(x))", "forall x. (Dog(x) -> Mineral(x))", "one faithful", 0.75),
        ("axiom", "Every black cat is an animal.", "forall x. (Cat(x) -> Animal(x))", "forall x. (BlackCat(x) -> Animal(x))", "modifier only", 0.75),
        ("axiom", every, "forall x. (Cat(x) -> Animal(x))", "forall x. (Animal(x) -> Cat(x))", "ambiguous", None),
        ("axiom", every, "Dog(rex)", "Mineral(stone)", "none faithful", None),
        ("axiom", "Tom is a cat.", "Cat(tom)", None, "rule faithful", 0.8), ("axiom", "Tom is a cat.", None, "Cat(tom)", "other faithful", 0.7),
        ("axiom", "Tom is a cat.", "Planet(pluto)", None, "not faithful", None),
        ("axiom", "Subject 6.5060 requires 6.100A.", "Requires(c6_5060, c6_100a)", None, "rule faithful", 0.8),
        ("axiom", None, "Cat(tom)", None, "not faithful", None),
    ]
    rows = [(i, "s", 1, t, text, a, b) for i, (t, text, a, b, _, _) in enumerate(cases)]
    got = {r.doc_id: r for r in admission.gate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[i].reason, got[i].confidence) for i in range(len(cases))] == [c[4:] for c in cases]
    assert got[4].fol == cases[4][2] and got[6].fol is None and got[6].status == "ambiguous" and got[10].shape == "other"


def test_known_predicates_and_relations(spark):
    rows = [(1, "a", 1, "axiom", "A right to full body ownership exists for Ann.", "RightToFullBodyOwnership(ann)", None), (1, "b", 2, "axiom", "Bob owns himself.", "RightToFullBodyOwnership(bob)", None),
            (2, "c", 1, "axiom", "Every man loves a woman.", "forall x. (Man(x) -> exists y. (Loves(x, y)))", None), (3, "d", 1, "axiom", "Ann loves Bob.", "LovesBob(ann)", "Loves(ann, bob)")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.stmt_id: r for r in admission.gate(df, allow_relations=True).collect()}
    assert got["b"].status == "accepted" and got["c"].shape == "relational-role(∀∃)"
    assert (got["d"].reason, got["d"].fol) == ("greater arity", "Loves(ann, bob)")


def test_constants(spark):
    df = spark.createDataFrame([("forall x, y. (R(x, b) and not S(c_1, y))",), ("P(a)",), ("",)], "f string")
    assert [r[0] for r in df.select(admission.constants(F.col("f"))).collect()] == [["b", "c_1"], ["a"], []]


def test_equivalence_of_a_pair_is_asked_once(monkeypatch):
    import pandas as pd

    calls, real = [], admission.sat.equivalent
    monkeypatch.setattr(admission.sat, "equivalent", lambda *a: calls.append(a) or real(*a))
    a, b, c = "forall x. (Crow(x) -> Bird(x))", "forall y. (not Bird(y) -> not Crow(y))", "Crow(tom)"
    got = admission._same(pd.Series([a, a, a, a, None]), pd.Series([b, b, c, a, a]))
    assert got.tolist() == [True, True, False, True, False] and len(calls) == 2


def test_gate_over_guarded_rows(spark):
    rows = [("d", "1", 1, "axiom", "Cats typically purr.", "Purring(cats)", None), ("d", "2", 2, "axiom", "Tom is a cat.", None, "Cat(tom)"), ("d", "3", 3, "axiom", None, None, None)]
    s = spark.createDataFrame(rows, "doc_id string, stmt_id string, pos long, type string, text string, rule string, other string")
    got = {r.stmt_id: (r.reason, r.fol) for r in admission.gate(s).collect()}
    assert got == {"1": ("hedged", None), "2": ("other faithful", "Cat(tom)"), "3": ("no formula", None)}
