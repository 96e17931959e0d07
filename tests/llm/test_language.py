"""The recurrent network against plain loops, its gradient against differences, and held-out accuracy."""

import math
import zlib

import numpy as np

from prooflake.llm import language as lang


def plain(net, text, window):
    """Mean probabilities over all positions, one byte and one unit at a time."""
    n, k = net.units, len(net.languages)
    sig = lambda v: 1 / (1 + math.exp(-v))

    def walk(way, data):
        h, out = [0.0] * n, []
        for b in data:
            e = net.embed[way][b].astype(float)
            zr = [sig(e[j] + sum(h[i] * float(net.gates[way][i][j]) for i in range(n))) for j in range(2 * n)]
            rh = [zr[n + i] * h[i] for i in range(n)]
            c = [math.tanh(e[2 * n + j] + sum(rh[i] * float(net.cand[way][i][j]) for i in range(n))) for j in range(n)]
            h = [h[i] + zr[i] * (c[i] - h[i]) for i in range(n)]
            out.append(h)
        return out

    total = np.zeros(k)
    for at in range(0, len(text), window):
        part = text[at : at + window]
        ahead, back = walk(0, part), walk(1, part[::-1])[::-1]
        for f, b in zip(ahead, back, strict=True):
            x = np.array(f) @ net.out[0] + np.array(b) @ net.out[1] + net.bias
            x = np.exp(x - x.max())
            total += x / x.sum()
    return total / len(text)


def test_pooled_equals_loops():
    net = lang.Network(["a", "b", "c"], units=3)
    texts = [b"hello w\xc3\xb6rld, this is longer", b"x", b"", bytes(range(20)), b"12345678", b"123456789"]
    got = net.pooled(texts, window=8)
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain(net, t, 8) if t else [1 / 3] * 3, atol=1e-5)


def test_gradient_equals_differences():
    net = lang.Network(["a", "b"], units=3, seed=1)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, sizes, labels = np.frombuffer(b"abcabbacbaacabca", np.uint8).reshape(4, 4), np.array([4, 3, 1, 4]), np.array([0, 1, 0, 1])
    _, grads = net.gradient(windows, sizes, labels)
    r = np.random.default_rng(0)
    for name, g in zip(net.NAMES, grads, strict=True):
        w = getattr(net, name)
        spots = np.argwhere(np.abs(g) > 0) if name == "embed" else np.argwhere(np.ones_like(w))
        for at in map(tuple, r.permutation(spots)[:12]):
            old, step = w[at], 1e-3
            w[at] = old + step
            up = net.gradient(windows, sizes, labels)[0]
            w[at] = old - step
            down = net.gradient(windows, sizes, labels)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-4, (name, at)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lang.predicted(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) > 0.96 * len(out)
    changed = docs.withColumn("lang", lang.F.when(lang.held_out(), "xx").otherwise(lang.F.col("lang")))
    again = {r.doc_id: r for r in lang.predicted(changed.selectExpr("doc_id", "text", "lang", "1 as has", "'x' as score")).collect()}
    assert again == got


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "été", None), (5, "the cat " * 40_000, "en"), (6, "der Hund", "de"), (6, "der Hund", "de"), (None, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang.predicted(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert all(r.lang_pred in {"en", "de", "fr"} and 0 <= r.score <= 1 for r in got if r.doc_id not in {1, 2, 3})
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 6}) == 1
    odd = df.selectExpr("doc_id", "cast(x'61ff62' as string) as text", "lang")
    assert lang.predicted(odd).count() == len(rows)
    blank = lang.predicted(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}
    assert lang.predicted(df.where("false")).count() == 0
