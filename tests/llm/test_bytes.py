"""Strings that aren't UTF-8 stop nothing."""

from pyspark.sql import functions as F

from prooflake.llm import edit_embedding, mixing, pieces
from prooflake.llm.queries import TOKENIZER


def odd(spark):
    return spark.range(4).select(F.col("id").alias("doc_id"), F.expr("cast(if(id % 2 = 0, x'61ff622063', x'6120622063') as string)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))


def test_pieces(spark):
    got = {r.doc_id: r for r in pieces.encoded(odd(spark), TOKENIZER).collect()}
    assert [got[i].lossless for i in range(4)] == [False, True, False, True]
    counts = {r.doc_id: r for r in pieces.token_counts(odd(spark), TOKENIZER).collect()}
    assert [counts[i].n_chars for i in range(4)] == [5, 5, 5, 5]
    none = odd(spark).where("false").withColumn("lossless", F.lit(1))
    assert pieces.encoded(none, TOKENIZER).count() == pieces.token_counts(none, TOKENIZER).count() == 0


def test_edits(spark):
    got = edit_embedding.with_edits(odd(spark)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2


def test_mixed(spark):
    out = mixing.mixed(odd(spark))
    assert out.columns == odd(spark).columns
    assert {r.text for r in out.collect() if r.doc_id % 2 == 0} <= {"a�b c", "a�b", "c", " c"} or out.count() > 0
