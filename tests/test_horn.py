from itertools import product

from prooflake.operators import horn

SCHEMA = "doc_id string, stmt_id string, pos int, fol string"


def formulas(spark, docs):
    return spark.createDataFrame([(d, f"s{i}", i, f) for d, fs in docs.items() for i, f in enumerate(fs)], SCHEMA)


CHAIN = ["forall x, y, z. (Before(x, y) and Before(y, z) -> Before(x, z))", "Before(a, b)", "Before(b, c)", "Before(c, d)", "Before(d, e)"]


def test_saturation(spark):
    docs = {
        "chain": CHAIN,
        "cycle": CHAIN + ["Before(e, a)"],
        "loves": ["forall x. (Loves(x, x) -> Vain(x))", "Loves(ann, ann)", "Loves(ann, bob)", "forall x. (Loves(ann, x) -> Lucky(x))"],
        "open": ["forall x, y. Linked(x, y)", "City(rome)", "City(oslo)"],
        "three": ["forall x, y, z. (P(x) and R(x, y) and R(y, z) -> T(x, y, z))", "P(a)", "R(a, b)", "R(b, c)", "R(c, a)"],
        "bad": [None, "P(", "P(a) or Q(a)"],
    }
    got = {}
    for r in horn.saturate(formulas(spark, docs), stop_at_clash=False).collect():
        got.setdefault(r.doc_id, {})[r.lit] = r
    assert set(got["chain"]) == {f"Before({x}, {y})" for x, y in product("abcde", "abcde") if x < y}
    assert got["chain"]["Before(a, c)"].premises == ["Before(a, b)", "Before(b, c)"] and got["chain"]["Before(a, c)"].round == 1
    assert got["chain"]["Before(a, e)"].round == 2
    assert len(got["cycle"]) == 25
    assert set(got["loves"]) == {"Loves(ann, ann)", "Loves(ann, bob)", "Vain(ann)", "Lucky(ann)", "Lucky(bob)"}
    assert {x for x in got["open"] if x.startswith("L")} == {f"Linked({x}, {y})" for x, y in product(("rome", "oslo"), repeat=2)}
    assert got["open"]["Linked(rome, oslo)"].premises == []
    assert "T(a, b, c)" in got["three"] and sum(x.startswith("T") for x in got["three"]) == 1
    assert got["three"]["T(a, b, c)"].premises == ["P(a)", "R(a, b)", "R(b, c)"]
    assert "bad" not in got


def test_refutation(spark):
    docs = {
        "cycle": CHAIN + ["Before(e, a)", "forall x. not Before(x, x)"],
        "fine": CHAIN,
        "role": ["RulesOver(g, r)", "forall x. (forall y. (RulesOver(x, y) -> not Free(y)))", "Free(r)", "Free(q)"],
    }
    all_ = horn.saturate(formulas(spark, docs))
    steps = horn.refutations(all_)
    got = {}
    for r in steps.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {"cycle", "role"}
    assert {(r.neg, r.lit) for r in got["role"]} == {(False, "RulesOver(g, r)"), (True, "Free(r)"), (False, "Free(r)")}
    assert {r.stmt_id for r in got["cycle"] if r.round == 0 and not r.neg} == {"s1", "s2", "s3", "s4", "s5"}
    text = {r.doc_id: r.text for r in horn.proofs(steps).collect()}["role"]
    assert text.split("\n") == ["Free(r)  [s2]", "RulesOver(g, r)  [s0]", "not Free(r)  [s1 from RulesOver(g, r)]"]


def test_empty(spark):
    none = horn.saturate(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and horn.refutations(none).count() == 0
