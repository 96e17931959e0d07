"""Statements carried across micro-batches."""

import json
import random

from prooflake.streaming import statements as streaming


def run(spark, tmp_path, name, cuts):
    """Chunks in files, one batch each, the query started anew for each."""
    at = tmp_path / name
    for k, rows in enumerate(cuts):
        if rows:
            spark.createDataFrame(rows, "doc_id string, chunk_ix long, raw string").coalesce(1).write.mode("append").parquet(str(at / "in"))
        chunks = spark.readStream.schema("doc_id string, chunk_ix long, raw string").parquet(str(at / "in"))
        streaming.stream_statements(chunks, str(at / "out"), str(at / "checkpoint")).awaitTermination()
    return sorted((r.doc_id, int(r.stmt_id[1:]), r.chunk_ix, r.type, r.text, tuple(r.inventory)) for r in spark.read.schema(streaming.OUT).parquet(str(at / "out")).collect())


def test_any_cut_gives_the_same(spark, tmp_path):
    r = random.Random(2)
    kinds = ["cat", "pet", "animal", "being"]
    chunks = []
    for d in ("x", "y"):
        for k in range(6):
            said = [r.choice([f"Every {a} is a {b}.", f"every  {a} is a {b}", f"Tom is a {a}."]) for a, b in (r.sample(kinds, 2) for _ in range(3))]
            chunks.append((d, k, json.dumps([{"type": "derived_claim", "decontextualized": s} for s in said])))
    chunks.append(("y", 6, "no json here"))
    ordered = sorted(chunks, key=lambda c: c[1])
    whole = run(spark, tmp_path, "one", [chunks])
    assert whole == run(spark, tmp_path, "many", [ordered[:3], ordered[3:4], ordered[4:]])
    assert whole == run(spark, tmp_path, "again", [ordered[:9], ordered[6:9], [], ordered[9:]])
    for d in ("x", "y"):
        own = [w for w in whole if w[0] == d]
        assert [w[1] for w in own] == list(range(1, len(own) + 1)) and own[0][5] == ()
        assert {w[3] for w in own if w[4].startswith("Tom")} <= {"axiom"}
        assert all(set(a[5]) <= set(b[5]) for a, b in zip(own, own[1:]))
