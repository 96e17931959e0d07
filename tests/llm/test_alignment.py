"""Cross-tokenizer alignment against the public tokenizers, one text at a time."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

from prooflake.llm import token_alignment as ta
from prooflake.llm.queries import BYTE_TOKENIZER, TOKENIZER

TEXTS = [
    "The cat sat on the mat.", "The cat sat on the mat.", None, "", " ", "   ", " lead", "trail ", "trail  \n", "a\n\n b\t c", "two  spaces   three", "naïve façade — “quoted” 12345 3.14",
    "日本語のテキスト and more", "emoji 👩‍👩‍👧 done", "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "nul\x00byte", "it's they're we'll I'd", "x" * 3000, " " * 500 + "end", " nbsp  em", "line\r\nline2 \r\n",
    "ab" * 2000 + " " + "the " * 1000, "der Übermut, naïveté; Å", "�", "\n", "word\n",
]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    raw = ta.bytes_of_a(ta.load(BYTE_TOKENIZER)), ta.bytes_of_b(ta.load(TOKENIZER))

    def ids(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        same = all(b"".join(r[i] for i in own) == (" " + text).encode() for r, own in zip(raw, (x, y), strict=True))
        return (x, y) if same else ([], [])

    def rows(docs):
        out, counts = [], Counter()
        for i, text in docs:
            sides, groups = ids(text), []
            ends = [list(accumulate(len(raw[k][j]) for j in own)) for k, own in enumerate(sides)]
            common = set(ends[0]) & set(ends[1])
            cut = [[n + 1 for n, e in enumerate(own) if e in common] for own in ends]
            for x, y in zip(zip([0, *cut[0]], cut[0]), zip([0, *cut[1]], cut[1]), strict=True):
                groups.append([sides[0][slice(*x)], sides[1][slice(*y)]])
            links = [(x[-1], y[-1]) for x, y in groups]
            counts.update(links)
            out.append((i, len(sides[0]), len(sides[1]), groups, links))
        most = {}
        for (_, y), n in counts.items():
            most[y] = max(most.get(y, 0), n)
        done = []
        for i, n_a, n_b, groups, links in out:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
            done.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha))
        return done

    return rows


def test_alignment_equals_plain(spark, plain):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as links", "1 as n", "'y' as a")
    got = ta.aligned(df.repartition(3), BYTE_TOKENIZER, TOKENIZER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs), key=repr)


def test_alignment_of_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, ta.aligned(docs, BYTE_TOKENIZER, TOKENIZER).collect()))
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))


def test_edges(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ta.aligned(none, BYTE_TOKENIZER, TOKENIZER).count() == 0
    odd = spark.range(1).selectExpr("id as doc_id", "cast(x'61ff62' as string) as text")
    assert tuple(ta.aligned(odd, BYTE_TOKENIZER, TOKENIZER).first()) == (0, 0, 0, 0, 0, 0, 0, "")
    both = ta.Tokenizers(ta.load(BYTE_TOKENIZER), ta.load(TOKENIZER))
    monkeypatch.setattr(ta, "KEPT", 2)
    texts = ["one two three", "two three four", "one"]
    first = [[x.tolist() for x in side] for side in both(texts)]
    assert [[x.tolist() for x in side] for side in both(texts)] == first
    assert ta.most_pairs([b"a", b"ba", b"b"], [b"a", b"cba"]) == 2 + 2


def test_long_text_takes_linear_time(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox " * 60_000)], "doc_id long, text string")
    r = ta.aligned(docs, BYTE_TOKENIZER, TOKENIZER).first()
    assert r.n_links == r.n_groups > 200_000
