"""Edges of verified statements."""

from prooflake.operators import report

SCHEMA = "doc_id int, stmt_id string, type string, status string, verdict string, support array<string>, conflict array<string>, text string"


def test_statements_are_read_once(spark):
    rows = [
        (1, "a", "axiom", "accepted", "contradicts", None, ["b", "c"], ""), (1, "b", "axiom", "accepted", "contradicts", [], ["a", "c"], ""), (1, "c", "axiom", "accepted", "contradicts", [], ["b", "a"], ""),
        (1, "d", "axiom", "accepted", "contradicts", [], ["a"], ""), (2, "a", "axiom", "accepted", None, None, None, ""), (2, "z", "derived_claim", "accepted", "entailed", ["a", "r"], [], ""), (3, "z", "axiom", "accepted", "contradicts", [], None, ""),
        (4, "z", "derived_claim", "accepted", "entailed", ["a"], [], ""), (4, "z", "derived_claim", "accepted", "entailed", ["a"], [], ""),
    ]
    e = report.edges(spark.createDataFrame(rows, SCHEMA))
    want = [(1, "b", "a", "conflict"), (1, "c", "a", "conflict"), (1, "d", "a", "conflict"), (2, "a", "z", "support"), (2, "r", "z", "support"), (4, "a", "z", "support"), (4, "a", "z", "support")]
    assert sorted(map(tuple, e.collect())) == want and e.columns == ["doc_id", "src", "dst", "label"]
    assert e._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
