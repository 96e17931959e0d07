"""Merge-dropout draws anew at each place: by document, pass and unit."""

from collections import Counter

import numpy as np
import pytest

from prooflake.llm import pieces

pytest.importorskip("sentencepiece")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def data():
    return pieces.load(MODEL)


def parted(bpe, text):
    """Segmentations of a text's units, by their first spaces."""
    out = []
    for i in np.frombuffer(bpe.encode(text), "<i4").tolist():
        piece = bpe.raw[i].decode()
        if piece.startswith(" "):
            out.append([])
        out[-1].append(piece)
    return Counter(map(tuple, out))


def plain(score, unit, rate, rng):
    """One segmentation by agenda with a coin for each candidate."""
    parts = list(" " + unit)
    gone = set()
    starts = list(range(len(parts)))
    while True:
        found = sorted((score[a + b], i) for (i, a), b in zip(zip(starts, parts, strict=True), parts[1:], strict=False) if a + b in score and (i, i + len(a + b), len(a)) not in gone)
        if not found:
            return tuple(parts)
        k = starts.index(found[0][1])
        if rng.random() < rate:
            gone.add((starts[k], starts[k] + len(parts[k] + parts[k + 1]), len(parts[k])))
            continue
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del starts[k + 1]


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_shares_of_segmentations(data, rate):
    got = parted(pieces.Bpe(data, rate), " ".join(["table"] * 20000))
    rng = np.random.default_rng(1)
    score = pieces.Bpe(data).order
    want = Counter(plain(score, "table", rate, rng) for _ in range(4000))
    assert len(got) > 2 and set(want) <= set(got)
    for s in got | want:
        assert abs(got[s] / 20000 - want[s] / 4000) < 0.035


def by_hash(bpe, text, place):
    """Ids by the plainest agenda: every candidate of the whole text is looked at anew for each merge."""
    whole = " " + text
    key = np.uint64(pieces._xxh(place, pieces._xxh(text.encode(), bpe.seed)))
    at = [(i, i + 1) for i in range(len(whole))]
    gone = set()
    while True:
        best = None
        for k, ((a, b), (_, c)) in enumerate(zip(at, at[1:], strict=False)):
            own = bpe.order.get(whole[a:c])
            if own is not None and (a, b, c) not in gone and (best is None or (own, a) < best[0]):
                best = (own, a), k, (a, b, c)
        if best is None:
            break
        _, k, candidate = best
        if bpe.rate and bpe.skipped(key, *[np.array([x]) for x in candidate])[0]:
            gone.add(candidate)
            continue
        at[k : k + 2] = [(candidate[0], candidate[2])]
    ids = []
    for a, b in at:
        own = bpe.id.get(whole[a:b])
        ids += [own] if own is not None else [int(bpe.byte[x]) for x in whole[a:b].encode()]
    return ids


@pytest.mark.parametrize("rate", [0, 0.1, 0.5, 1])
def test_equals_plain_agenda(data, rate, monkeypatch):
    texts = ["the committee   has considered \t the straightforward propositions\n\nand", "  a", "x", "\u2581literal \u2581 mark", "\u4e2d\u6587\u5b57\u7b26 \U0001f600\u0301e\u0301", "bookkeeper" * 9, "committee " * 20, "\x00\x01"]
    bpe = pieces.Bpe(data, rate)
    places = [f"{i} 0" for i in range(len(texts))]
    want = [by_hash(bpe, t, p) for t, p in zip(texts, places, strict=True)]
    assert [x.tolist() for x in bpe.encode_all(texts, places)] == want
    monkeypatch.setattr(pieces, "WIDTHS", (4,))  # longer units by the heap
    assert [x.tolist() for x in bpe.encode_all(texts, places)] == want
    monkeypatch.setattr(pieces, "PART", 8)  # texts in parts
    assert [x.tolist() for x in bpe.encode_all(texts, places)] == want


def test_edges(spark, data):
    """Nulls, empty and very long texts, repeated rows, an empty table, clashing names of further columns."""
    long = "a very long text without end " * 60_000 + "x" * 5000
    docs = spark.createDataFrame([(None, "one", 1), (1, None, 2), (2, "", 3), (3, long, 4), (3, long, 5)], "doc_id long, text string, ids long")
    got = {(r.doc_id, r.n_pieces, r.lossless) for r in pieces.encoded(docs, MODEL).collect()}
    assert len(got) in (4, 5) and all(x[2] for x in got) and {(1, 0, True), (2, 0, True)} <= got
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0


def test_short_and_long_units(data):
    assert len(parted(pieces.Bpe(data, 0.1), " ".join(["the"] * 2000))) > 1
    assert all(len(s) == 6 for s in parted(pieces.Bpe(data, 1.0), "table " * 9 + "table"))
    long = pieces.Bpe(data, 0.3)
    text = "straightforward" * 40
    assert long.encode(text, "1 0") != long.encode(text, "2 0") and long.decode(long.encode(text)) == text


def test_documents_and_passes_differ(spark):
    text = "the mixture repeats a document up to three times and each pass is drawn anew " * 5
    docs = spark.createDataFrame([(1, text), (2, text), (1, text), (1, text), (None, text)], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    got = [r.ids_sha256 for r in pieces.encoded(docs, MODEL).collect()]
    assert len(set(got)) == 5
    assert got == [r.ids_sha256 for r in pieces.encoded(docs, MODEL).collect()]
    assert len({r.ids_sha256 for r in pieces.encoded(docs, MODEL, rate=0.0).collect()}) == 1
