import re
import xml.etree.ElementTree as ET

from prooflake.operators import horn, render
from prooflake.sources import extraction, runs

PROPS = "doc_id string, stmt_id string, type string, status string, verdict string, support array<string>, conflict array<string>, text string"


def props(spark):
    rows = [
        ("d", "s1", "axiom", "accepted", "contradicts", [], ["s2"], "A < B & C"), ("d", "s2", "axiom", "accepted", "contradicts", [], ["s1"], None),
        ("d", "s3", "derived_claim", "accepted", "entailed", ["s1", "zz"], [], "x" * 100), ("d", "s10", "axiom", "quarantined", None, None, None, ""),
        ("e", "s1", "axiom", "accepted", None, [], [], "alone"),
    ]
    return spark.createDataFrame(rows, PROPS)


def test_svg(spark):
    got = {r.doc_id: ET.fromstring(r.svg) for r in render.svg(props(spark), across=2).collect()}
    tag = lambda e, t: e.findall(f"{{http://www.w3.org/2000/svg}}{t}")
    assert len(tag(got["d"], "rect")) == 4 and len(tag(got["e"], "rect")) == 1 and not tag(got["e"], "line")
    assert sorted("stroke-dasharray" in x.attrib for x in tag(got["d"], "line")) == [False, True]
    assert [t.text for t in tag(got["d"], "text")][1] == "A < B & C"
    assert int(got["d"].attrib["width"]) > int(got["e"].attrib["width"])


def test_batch_summary(spark):
    flags = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, a int")
    got = {r.doc_id: r for r in render.batch_summary(props(spark), flags).collect()}
    assert tuple(got["d"])[1:5] == (4, 1, 1, 2) and tuple(got["e"])[1:5] == (1, 0, 0, 0)
    assert len(got["d"].line) == len(got["e"].line) == 104


def test_runs(spark, tmp_path):
    p = props(spark)
    stages = runs.Stages()
    with stages.stage("write"):
        runs.write_run(str(tmp_path), {"store": p}, {"notes": p.selectExpr("doc_id", "stmt_id AS text")})
    store = runs.read_run(spark, str(tmp_path), "store")
    assert store.count() == 5 and spark.read.json(f"{tmp_path}/notes").count() == 5
    done = store.where("doc_id = 'd'")
    assert [r.stmt_id for r in runs.pending(p, done, "doc_id", "stmt_id").collect()] == ["s1"]
    assert [r.stage for r in stages.table(spark).collect()] == ["write"]
    assert runs.Stages().table(spark).count() == 0


def test_stress_documents(spark):
    """The chains hold what they say, whatever a rule's wording."""
    docs = extraction.stress_documents(spark, per_cell=2, depths=(2, 3), clutter=(0, 5)).collect()
    assert len(docs) == 16 and {(r.depth, r.distractors, r.expected) for r in docs} == {(a, b, c) for a in (2, 3) for b in (0, 5) for c in (0, 1)}
    rows = []
    for r in docs:
        lines = r.text.split("\n")
        assert len(lines) == r.statements == r.depth + 3 + r.distractors
        for i, line in enumerate(lines):
            ends = re.findall(r"rung\d+|insured", line)
            who = re.search(r"Crate\w+", line)
            f = f"forall x. ({ends[0]}(x) -> {ends[1]}(x))" if len(ends) == 2 else f"{'not ' * (' not ' in line)}{ends[0]}({who[0].lower()})"
            rows.append((r.doc_id, str(i), i, f))
    literals = horn.saturate(spark.createDataFrame(rows, "doc_id long, stmt_id string, pos int, fol string"))
    assert {int(r.doc_id) for r in horn.clashes(literals).collect()} == {r.doc_id for r in docs if r.expected}
