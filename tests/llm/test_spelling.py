"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prooflake.llm import spelling


def apart(u: str, v: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return any(u == v[:i] + v[i + 1 :] for i in range(len(v)))


def plain(docs, least=5, seen=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= seen}
    near = {w: sorted((v for v in counts if apart(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: v[0] if v and counts[v[0]] >= 2 * counts[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus(seed, n=300, letters="abcdé÷", sizes=(4, 9)):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(40)]
    out = []
    for i in range(n):
        ws = []
        for _ in range(30):
            w = r.choice(base[: r.randint(1, 40)])
            if r.random() < 0.5:
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]])
            ws.append(w.upper() if r.random() < 0.2 else w)
        out.append((i, r.choice([" ", "-", "7"]).join(ws)))
    return out


@pytest.mark.parametrize("limit", [20_000, 40])
def test_variants_equal_all_pairs(spark, limit):
    docs = corpus(limit) + [(None, "weird wéird weird weird"), (1, None), (2, ""), (3, "Straße STRASSE straße straße"), (4, "ÀÉÎ àéîou àéîou àéîou ÀÉÎou")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as word", "1 as n", "2 as size").repartition(3)
    assert got(spelling.variants(df, limit=limit, shard=500)) == plain(docs)


def test_hot_beginnings_and_endings(spark):
    """All words share a long beginning or ending: groups are halved until they are small."""
    docs = [(i, " ".join(w + x for w in ("abcdefgh", "abcdefg") for x in ("", "x", "y", chr(97 + i % 26), chr(97 + i % 26) + chr(97 + i // 26))) + " " + " ".join(chr(97 + i % 26) + "stuvwxyz" for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(spelling.variants(df, limit=10)) == plain(docs)
    rows = spelling.dealt(spelling.words(df), limit=10)
    open_ = rows.selectExpr("size - lo - hi as open", "count(*) over (partition by size, lo, hi, first, last) as many")
    assert open_.where("many > 10 and open > 1").isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=4), min_size=1, max_size=20))
def test_automaton_numbers(words):
    own = sorted(w.encode() for w in words)
    table = np.array(own, "S4").view(np.uint8).reshape(len(own), 4)
    letters = np.where(table > 0, table - 96, 0).astype(np.uint8)
    a = spelling.Automaton(letters, (table > 0).sum(axis=1))
    for i, w in enumerate(own):
        s, n = a.start, 0
        for c in w:
            n += a.skip[s, c - 96]
            s = a.step[s, c - 96]
        assert a.final[s] and n == i
    ends = {(tuple(a.step[s]), bool(a.final[s])) for s in range(1, len(a.final))}
    assert len(ends) == len(a.final) - 1  # minimal: no two states alike


def test_empty_and_odd(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    out = spelling.variants(none)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    odd = spark.range(3).selectExpr("7 as doc_id", "cast(x'6162636465ff6162636465' as string) as text")
    assert got(spelling.variants(odd)) == [("abcde", "", "abcde", 6, 0, 0)]
    long = spark.createDataFrame([(i, "z" * 40_000 + " " + "z" * 39_999) for i in range(3)], "doc_id long, text string")
    assert [r[3:5] for r in got(spelling.variants(long))] == [(3, 1), (3, 1)]
