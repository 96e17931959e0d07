"""A run from a folder of documents to artefacts."""

import json

from prooflake.operators import corpus, theory
from prooflake.sources import folder

ESSAY = """The sage.

All sages doubt. Zeno was a
sage.

Every doubter is wise. Zeno is wise. Zeno never sleeps like a fox made of rain.

Zeno is tall. Zeno is not tall."""
FOUND = [
    {"id": "s1", "type": "axiom", "original_text": "All sages doubt.", "decontextualized": "Every sage doubts."},
    {"id": "s2", "type": "derived_claim", "original_text": "Zeno was a sage.", "decontextualized": "Zeno is a sage."},
    {"id": "s3", "type": "axiom", "original_text": "Every doubter is wise.", "decontextualized": "Every doubter is wise."},
    {"id": "s4", "type": "derived_claim", "original_text": "Zeno is wise.", "decontextualized": "Zeno is wise."},
    {"id": "s5", "type": "rhetorical", "original_text": "Zeno never sleeps like a fox made of rain."},
    {"id": "s6", "type": "axiom", "original_text": "Zeno is tall.", "decontextualized": "Zeno is tall."},
    {"id": "s7", "type": "axiom", "original_text": "Zeno is not tall.", "decontextualized": "Zeno is not tall."},
]
FORMULAS = {"s1": "forall x. (Sage(x) -> Doubter(x))", "s2": "Sage(zeno)", "s3": "forall x. (Doubter(x) -> Wise(x))", "s4": "Wise(zeno)", "s5": None, "s6": "Tall(zeno)", "s7": "not Tall(zeno)"}


def write(at, stem, text, found, formulas=None, bridges=None):
    (at / f"{stem}.txt").write_text(text)
    (at / f"{stem}.extraction.json").write_text(json.dumps(found))
    if formulas:
        (at / f"{stem}.translation.json").write_text(json.dumps(formulas))
    if bridges:
        (at / f"{stem}.bridges.json").write_text(json.dumps(bridges))


def test_folder_to_artefacts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    write(src, "the sage", ESSAY, FOUND, FORMULAS)
    write(src, "tax", "The author promised no new taxes. The author raised a levy.", [{"id": "t1", "type": "axiom", "original_text": "The author promised no new taxes.", "decontextualized": "No promise is a tax."}, {"id": "t2", "type": "axiom", "original_text": "The author raised a levy.", "decontextualized": "Levy1 is a promise."}], None, [{"id": "b1", "fol": "forall x. (Promise(x) -> Tax(x))"}])
    (src / "alone.txt").write_text("No statements here.")
    again = [{"type": "axiom", "decontextualized": "Tom is a cat."}, {"type": "axiom", "decontextualized": "tom is a  cat"}, {"type": "axiom", "decontextualized": "Every cat is a pet."}]
    write(src, "long", ("Tom is a cat.\n\n" + "word " * 250 + "\n\n") * 3 + "Every cat is a pet.", again, None)
    done = corpus.run_folder(spark, str(src), str(out))
    assert {r.doc_id for r in done.collect()} == {"the sage", "tax", "alone", "long"}
    got = {(r.doc_id, r.name): r.text for r in folder.read_artefacts(spark, f"{out}/artefacts").collect()}
    assert {d for d, _ in got} == {"the sage", "tax", "long"} and {n for _, n in got} == set(corpus.ARTEFACTS)
    store = {p["stmt_id"]: p for p in json.loads(got["the sage", "store.json"])}
    assert store["s6"]["verdict"] == store["s7"]["verdict"] == "contradicts" and store["s6"]["conflict"] == ["s7"]
    assert store["s4"]["verdict"] == "entailed" and sorted(store["s4"]["support"]) == ["s1", "s2", "s3"]
    assert store["s2"]["type"] == "axiom" and store["s5"]["status"] == "quarantined" and "verdict" not in store["s5"]
    for p in store.values():
        assert "".join(ESSAY[p["span"]["start"] : p["span"]["end"]].split()) == "".join(p["original"].split())
    md, tree = got["the sage", "report.md"], got["the sage", "theory_tree.txt"]
    assert "### {s6, s7} (self-contained)" in md and "follows from: s1, s2, s3" in md and tree in md and "## Set aside" in md
    assert "|   `-- proved from [s3] AX Every doubter is wise." in tree or "    `-- proved from [s3] AX Every doubter is wise." in tree
    assert "minimal inconsistent set" in tree and "set aside (1)" in tree
    tax = json.loads(got["tax", "report.json"])
    assert "(bridged)" in got["tax", "report.md"] and "Only found if one also accepts b1" in got["tax", "report.md"] and tax["summary"] == {"contradicts": 3}
    whole = json.loads(got["long", "report.json"])
    assert whole["chunked"] and [p["stmt_id"] for p in whole["propositions"]] == ["s1", "s2"]
    lines = spark.read.parquet(f"{out}/tables/lineage").where("doc_id = 'long'").collect()
    assert sorted((r.source_id, r.stmt_id) for r in lines) == [("s1", "s1"), ("s2", "s1"), ("s3", "s2")]
    # Killed before the documents were listed, and run again: the same. A run with nothing to do leaves all as it is.
    first = {(r.doc_id, r.name): r.text for r in folder.read_artefacts(spark, f"{out}/artefacts").collect()}
    assert corpus.run_folder(spark, str(src), str(out)).count() == 0
    corpus.run_folder(spark, str(src), str(out), resume=False)
    assert {(r.doc_id, r.name): r.text for r in folder.read_artefacts(spark, f"{out}/artefacts").collect()} == first


def plain_outline(nodes, parts):
    seen, lines = set(), []

    def show(n, depth):
        lines.append((depth, n, n in seen and bool(parts.get(n))))
        if n not in seen:
            seen.add(n)
            for p in parts.get(n, []):
                show(p, depth + 1)

    used = {p for ps in parts.values() for p in ps}
    for n in nodes:
        if n not in used:
            show(n, 0)
    for n in nodes:
        if n not in seen:
            show(n, 0)
    return lines


def test_outline_equals_depth_first_search(spark):
    import random

    r, nodes, edges, want = random.Random(5), [], [], {}
    for d in range(25):
        own = [f"n{i}" for i in range(r.randint(1, 9))]
        parts = {}
        for i, n in enumerate(own):
            free = own if d % 5 == 0 else own[i + 1 :]
            parts[n] = sorted(r.sample(free, r.randint(0, min(3, len(free)))), key=own.index)
        nodes += [(d, n, i) for i, n in enumerate(own)] + [(d, own[0], 0)]
        edges += [(d, n, p) for n, ps in parts.items() for p in ps] + [(d, own[0], "gone")]
        want[d] = plain_outline(own, parts)
    got = theory.outline(spark.createDataFrame(nodes, "doc_id int, node string, pos int"), spark.createDataFrame(edges, "doc_id int, node string, part string"))
    by: dict = {}
    for x in sorted(got.collect(), key=lambda x: (x.doc_id, x.line)):
        by.setdefault(x.doc_id, []).append((x.depth, x.node, x.above))
    assert by == want


def test_outline_walks_each_shape_once(spark, monkeypatch):
    """Documents that are equal up to names are walked once; large ones, and ones with a null pos, by themselves."""
    walk, walked = theory._walked, []

    def counted(nodes, edges):
        walked.append(nodes.select("doc_id").distinct().count())
        return walk(nodes, edges)

    monkeypatch.setattr(theory, "_walked", counted)
    own = {d: [f"{d} n{i}" for i in range(4)] for d in range(40)} | {40: [f"40 n{i:02}" for i in range(70)], 41: ["41 a", "41 b"]}
    parts = {d: {ns[0]: [ns[1], ns[2]], ns[1]: [ns[2]]} if d % 2 else {ns[0]: [ns[3]]} for d, ns in own.items() if d < 40}
    parts |= {40: {n: own[40][i + 1 : i + 2] for i, n in enumerate(own[40])}, 41: {"41 b": ["41 a"]}}
    nodes = [(d, n, None if d == 41 and i == 0 else i) for d, ns in own.items() for i, n in enumerate(ns)] + [(0, None, 0), (None, "n", 0)]
    edges = [(d, n, p) for d, by in parts.items() for n, ps in by.items() for p in ps for _ in range(2)] + [(0, own[0][0], None), (None, "n", "n"), (99, "x", "y")]
    got = theory.outline(spark.createDataFrame(nodes, "doc_id int, node string, pos int"), spark.createDataFrame(edges, "doc_id int, node string, part string"))
    by: dict = {}
    for x in sorted(got.collect(), key=lambda x: (x.doc_id, x.line)):
        by.setdefault(x.doc_id, []).append((x.depth, x.node, x.above))
    assert by == {d: plain_outline(own[d], parts[d]) for d in own} and walked == [2, 2]
