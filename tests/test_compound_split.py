"""Clauses by cases, and compound_split over all documents, whatever their language."""

import re

import pytest
from pyspark.sql import functions as F

from prooflake.operators.segment import clauses
from prooflake.plans.catalog import QUERIES

CASES = {
    "Aldous is a laureate, having been elevated at a meeting.": ["Aldous is a laureate.", "having been elevated at a meeting."],
    "Aldous is a laureate who was elevated to the highest grade.": ["Aldous is a laureate.", "Aldous was elevated to the highest grade."],
    "Aldous is a laureate.": None,
    "The records, which are stored in the archive, are public.": None,
    "Socrates is wise, and Plato is young.": ["Socrates is wise.", "Plato is young."],
    "Socrates was a philosopher and believes in reason.": ["Socrates was a philosopher.", "Socrates believes in reason."],
    "Bread and butter is food.": None,
    "Every person who is bound by the oath publishes their decisions.": None,
    "If it rains and it pours, the road is wet.": None,
    "When X is located in Y and Y is located in Z, X is located in Z.": None,
    "Either the class is owned by everyone and no one owns it, or one group rules it.": None,
    "The relation is transitive: if X precedes Y and Y precedes Z, then X precedes Z.": None,
    "  Ada is a poet and Bo is a painter...  ": ["Ada is a poet.", "Bo is a painter."],
    "Ada is here, and Bo is there, and Cy is away": ["Ada is here,.", "Bo is there, and Cy is away."],
    "Élodie is a nurse who has été élue": None,
    "x": None,
}


@pytest.mark.parametrize("batch", [list(CASES)])
def test_cases(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*batch, None])], "i int, s string")
    got = [r.c for r in df.select("i", clauses(F.col("s")).alias("c")).orderBy("i").collect()]
    assert got == [CASES[s] or [s] for s in batch] + [None]


def test_all_languages(spark, tmp_path):
    texts = ["Socrates is a man and Plato is a sage. No end", "Every man is mortal, and some sages are wise! x.", "Plato is a sage who was born here.\nAda is a woman, who has ideas", "", None]
    parts = {
        "Socrates is a man and Plato is a sage.": ["Socrates is a man.", "Plato is a sage."],
        "Every man is mortal, and some sages are wise!": ["Every man is mortal.", "some sages are wise!."],
        "Plato is a sage who was born here.": ["Plato is a sage.", "Plato was born here."],
        "Ada is a woman, who has ideas": ["Ada is a woman.", "who has ideas."],
    }
    docs = [(i, texts[i % 5], lang) for i, lang in enumerate(["en"] * 5 + ["de"] * 5 + [None] * 5 + ["fr", "EN", ""] * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, _ in docs:
        found = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", text or "")]
        for ix, s in enumerate(s for s in found if len(s) > 3):
            own = parts.get(s, [s])
            want += [(i, f"{ix}.{k + 1}" if len(own) > 1 else str(ix), k, p) for k, p in enumerate(own)]
    got = QUERIES["compound_split"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.part for r in got)
