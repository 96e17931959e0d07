import pytest
from pyspark.sql import functions as F

from prooflake.functions import formulas, text
from prooflake.logic import fol
from prooflake.operators import relational, report, vocab
from prooflake.sources import extraction


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_span(spark):
    raw = "One  two\nthree. One two (x)+ a\\Eb"
    span = lambda v: text.span(F.lit(raw), v)
    got = column(spark, ["two three.", "One two", "(x)+", "a\\Eb", "absent", "  ", None], span)
    assert [s and raw[s["start"] : s["end"]] for s in got] == ["two\nthree.", "One  two", "(x)+", "a\\Eb", None, None, None]


def test_labels(spark):
    assert column(spark, ["abcdefgh", "abcde", "", None], lambda v: text.shortened(v, 6)) == ["abc...", "abcde", "", None]
    assert column(spark, ['<a href="x">&</a>', ""], text.xml_escaped) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;", ""]


def test_word_matches(spark):
    lemmas = F.array(F.lit("tax"), F.lit("philosophy"), F.lit("cat"))
    assert column(spark, ["taxes", "philosophers", "cats", "catalogue", "dog"], lambda v: text.word_matches(v, lemmas)) == [True, True, True, False, False]


@pytest.mark.parametrize("raw, out", [('x {"a": "}"} y', '{"a": "}"}'), ("[1, [2]] z", "[1, [2]]"), ('[{"a": 1}]', '{"a": 1}'), ("{ [1] ", "[1]"), ('{"a": "\\"}"}', '{"a": "\\"}"}'), ("none", None), ("", None), (None, None)])
def test_balanced(raw, out):
    assert text.first_balanced(raw) == out


def test_extraction_repair(spark):
    rows = [
        (1, '```json\n[{"id": "a", "type": "odd", "decontextualized": "X is Y."}, null, " Z is W. ", "", {"type": "axiom"}, {"original_text": "Q"}]\n```'),
        (2, 'Sure: {"result": [{"type": "hypothetical", "decontextualized": "If so."}]} as asked'),
        (3, '{"id": "one", "original_text": "Alone."}'), (4, "nothing"), (5, ""), (6, None), (7, "[]"),
    ]
    got = extraction.statements(spark.createDataFrame(rows, "doc_id int, raw string")).orderBy("doc_id", "pos")
    assert [(r.doc_id, r.stmt_id, r.type, r.text) for r in got.collect()] == [
        (1, "a", "axiom", "X is Y."), (1, "s2", "axiom", "Z is W."), (1, "s4", "axiom", "Q"), (2, "s1", "hypothetical", "If so."), (3, "one", "axiom", "Alone.")
    ]


def test_formula_text(spark):
    fs = ["forall x. (A(x) -> (B(x) and not R(x, c)))", "P(a) <-> exists y. (Q(y))", "not Über(x)"]
    assert column(spark, fs, formulas.tokens) == [fol.tokens(f) for f in fs]
    assert column(spark, fs, formulas.predicates) == [sorted({a[0] for a in fol.atoms(fol.parse(f))}) for f in fs]
    assert column(spark, [*fs, "", None], formulas.max_arity) == [2, 1, 1, 0, 0]
    assert column(spark, ["A(x) & B", "A(x)"], formulas.untokenized) == ["&", ""]


def test_modifiers(spark):
    same = lambda v: formulas.modifier_only(v, F.lit("forall x. (PrimeNumber(x) -> Odd(x))"))
    assert column(spark, ["forall x. (Prime(x) -> Odd(x))", "forall x. (Even(x) -> Odd(x))", "forall x. (Prime(x) -> not Odd(x))"], same) == [True, False, False]


def test_aliases(spark):
    f = spark.createDataFrame([(1, 1, "A(x) and B(A, y)"), (1, 2, "B(a, b) -> B(b, c)"), (2, 1, "A(x)")], "doc_id int, pos int, fol string")
    a = spark.createDataFrame([(1, "A", "B2", False), (1, "B", "A", True)], "doc_id int, old string, new string, swap boolean")
    got = {(r.doc_id, r.pos): r.fol for r in vocab.apply_aliases(f, a).collect()}
    assert got == {(1, 1): "B2(x) and A(y, B2)", (1, 2): "A(b, a) -> A(c, b)", (2, 1): "A(x)"}
    known = {(r.doc_id, r.pos, r.pred): r.known for r in vocab.known_before(f).collect()}
    assert known == {(1, 1, "A"): False, (1, 1, "B"): False, (1, 2, "B"): True, (2, 1, "A"): False}


def test_generated_documents_are_judged(spark):
    docs = extraction.chain_documents(spark, 2)
    assert docs.count() == 20 and docs.groupBy("hops", "expected").count().where("count <> 2").count() == 0
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    found = relational.verdicts(lines).withColumnRenamed("inconsistent", "found")
    assert report.scored(docs, found).where("found IS NULL OR found <> expected").count() == 0


def test_report(spark):
    rows = [(1, "s1", "axiom", "accepted", "contradicts", ["s2"], []), (1, "s2", "bridge", "accepted", "contradicts", ["s1"], []), (1, "s3", "derived_claim", "accepted", "entailed", [], ["s1"]), (1, "s4", "axiom", "quarantined", None, None, None)]
    props = spark.createDataFrame([(*r, 'Say "it"') for r in rows], "doc_id int, stmt_id string, type string, status string, verdict string, conflict array<string>, support array<string>, text string")
    assert [tuple(r) for r in report.conflict_sets(props).collect()] == [(1, ["s1", "s2"], True)]
    assert {(r.src, r.dst, r.label) for r in report.edges(props).collect()} == {("s1", "s3", "support"), ("s2", "s1", "conflict")}
    assert {r.stmt_id: r.kind for r in report.nodes(props).collect()} == {"s1": "axiom", "s2": "bridge", "s3": "entailed", "s4": "excluded"}
    (row,) = report.dot(props).collect()
    assert row.dot.count("->") == 2 and row.dot.startswith("digraph theory {") and row.dot.endswith("}") and "Say 'it'" in row.dot
