"""Repeated strings at the registered length, with a line that most documents share, against brute force."""

import hashlib
import random

import pytest

from prooflake.llm import suffix_dedup

DOCS = "doc_id long, text string, n_bytes long, n_removed int, n_spans int, kept string, kept_sha256 string, n_chars int"


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(400))
    line = " ".join(word() for _ in range(27))[:170]  # shorter than a string: only what stands beside it can repeat
    passage = " ".join(word() for _ in range(90))
    out = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(10, 120))]
        w.insert(rng.randrange(len(w)), line)
        if i % 10 == 0:
            w.insert(rng.randrange(len(w)), passage[rng.randrange(60) :])
        out.append(" ".join(w))
    out += ["é" * 300, "x" * 1000, "ab" * 150, out[3] + " " + out[3], out[7], None, "", "short"]
    out += [f"{a}{line} {a}" for a in ("same start of twenty b", "same start of twenty b", "other start of twenty ") for _ in range(2)]
    return out


def brute(texts, n):
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            gone[i][p : p + n] = b"\1" * n
    return [(len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), bytes(c for c, x in zip(t, g, strict=True) if not x)) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("family", [suffix_dedup.FAMILY, 40, 2])
def test_whole_length(spark, family):
    texts = corpus()
    want = brute(texts, suffix_dedup.MIN_LEN)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "4", "5", 6) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, family=family).collect()}
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}
    assert sum(w[1] > 0 for w in want) > 20


def test_removed_with_clashing_columns(spark):
    texts = corpus()
    want = brute(texts, suffix_dedup.MIN_LEN)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "4", "5", 6) for i, t in enumerate(texts)], DOCS)
    got = suffix_dedup.removed(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r for r in got.collect()}
    for i, w in enumerate(want):
        text = w[3].decode("utf-8", "ignore")
        assert tuple(kept[i]) == (i, text, 1, 2, 3, "4", "5", len(text))
