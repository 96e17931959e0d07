"""Small cases against brute force: nulls, empties, repeated rows, ties, extra columns, empty tables."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from prooflake.llm import edit_embedding, mixing, pieces, quality, simhash, suffix_dedup, url_filter, voronoi_knn, warc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, spans int"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "日本"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = words(rng, 80)
    texts = [base, base, base + " tail", None, "", " \n", "x", "a" * 900, words(rng, 3000), words(rng, 60) + base[:260], "héllo wörld", words(rng, 40), base.replace("beta", "BETA")]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "k", i) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "null id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://c/", "WARC/1.1\r\nx\r\n\r\n\r\n"), (None, "http://d/", "<p>é</p>"), (2, "http://b/", "<p>é</p>")]
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min(p for p, _, x in pages if (x or "") == (h or "") and p)
        want.append((i or -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def record(n, body):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, warc.sha1_base32(body).encode(), len(body), body)


def test_warc_salvage():
    rs = [record(i, b"body %d " % i * 20) for i in range(6)]
    bad = rs[2].replace(b"body 2", b"bodY 2", 1)
    out = list(warc.salvage(rs[0] + rs[1] + bad + b"junk" + rs[3] + rs[4][:-30] + rs[5]))
    assert [x["headers"]["warc-record-id"] for x in out if x["kind"] == "record"] == ["<0>", "<1>", "<3>", "<5>"]
    gaps = [(x["start"], x["stop"]) for x in out if x["kind"] == "gap"]
    assert gaps[0] == (len(rs[0] + rs[1]), len(rs[0] + rs[1] + bad) + 4) and len(gaps) == 2
    members = [gzip.compress(r) for r in rs]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    out = list(warc.salvage(members[0] + members[1] + bytes(broken) + members[3] + b"\0" * 7 + members[4] + members[5][:-9]))
    assert {"<0>", "<1>", "<3>", "<4>"} <= {x["headers"]["warc-record-id"] for x in out if x["kind"] == "record"}
    assert any(x["kind"] == "gap" for x in out) and list(warc.salvage(b"")) == []


def test_bpe(docs, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    data = pieces.load(MODEL)
    own, sp = pieces.Bpe(data), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r[1] or "" for r in rows] + ["  two  spaces ", "tab\tand\nline", "e.g. don't, U.S.A. x² m².", "\x00", "$100,000.00 (ok)"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<i4").tolist() == sp.encode(t)
    for rate in (0.1, 0.5, 1.0):
        drop = pieces.Bpe(data, rate)
        for t in [*texts, "▁ literal ▁"]:
            assert drop.decode(drop.encode(t)) == t
    assert pieces.Bpe(data, 0.3, seed=1).encode(texts[0]) != pieces.Bpe(data, 0.3, seed=2).encode(texts[0])
    assert pieces.Bpe(data, 0.3, seed=1).encode(texts[0]) == pieces.Bpe(data, 0.3, seed=1).encode(texts[0])
    got = pieces.encoded(docs, MODEL).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)


def test_token_counts(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers

    data = pieces.load(MODEL)
    t = tokenizers.Tokenizer(models.Unigram(pieces.unigram(data), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in pieces.token_counts(docs, MODEL).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def test_mixing(docs, rows, none):
    got = mixing.taken(docs, block=8).collect()
    again = mixing.taken(docs, block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target, 0])
        by[r.source][0] += r.taken
        by[r.source][2] += r["size"]
    for took, target, size in by.values():
        assert abs(took - target) <= 16 and target <= 3 * size
    assert mixing.taken(none).count() == 0
    out = mixing.mixed(docs, block=8)
    assert out.columns == docs.columns and sum(len((r.text or "").encode().split()) for r in out.collect()) == sum(r.taken for r in got)
    clash = docs.selectExpr("*", "1 as size", "2 as uid", "3 as z", "4 as runs", "5 as place", "6 as c0")
    assert mixing.mixed(clash, block=8).columns == clash.columns and mixing.mixed(clash, block=8).count() == out.count()
    moved = mixing.taken(docs.repartition(7), block=8).collect()
    assert sorted(map(str, moved)) == sorted(map(str, got))
    assert sorted(mixing.permuted(np.arange(1000), 1000, [1]).tolist()) == list(range(1000))
    assert mixing.targets({"a": 10, "b": 100, None: 0}) == {"a": 30.0, "b": 80.0, None: 0.0}


def test_simhash(docs, rows, none):
    import xxhash

    def plain(t):
        w = [x for x in (t or "").encode().lower().split()]
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [plain(r[1]) for r in rows]
    got = simhash.components(docs).collect()
    assert sorted(r.fp for r in got) == sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            comp[i] = min(comp[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    want = sorted((r[0] if r[0] is not None else -1, min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None) if any(comp[j] == comp[i] and rows[j][0] is not None for j in range(len(rows))) else None) for i, r in enumerate(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got) == want
    assert simhash.components(none).count() == 0


def test_vantage_point_links():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.unique(np.concatenate([centres, *[centres[:20] ^ (np.uint64(1) << rng.integers(0, 63, 20, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 20, np.uint64)) for _ in range(40)]]))
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = simhash.forest(fps[near[:, 0]], fps[near[:, 1]])
    shard, ix, home = simhash.route(simhash.grow(fps[::3], 5), fps, 3)
    a, b = [], []
    for s in np.unique(shard):
        x, y = simhash.links(fps[ix[(shard == s) & home]], fps[ix[(shard == s) & ~home]], 3, leaf=8)
        a.append(x)
        b.append(y)
    got = simhash.forest(np.concatenate(a), np.concatenate(b))
    assert home.sum() == len(fps) and all((g == w).all() for g, w in zip(got, want, strict=True))


def test_cells_of_shards(spark):
    """Shards dealt to cells by blocks of bits lose no pair."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 400, np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:150] ^ (np.uint64(1) << rng.integers(0, 62, 150, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 62, 150, np.uint64)) for _ in range(8)]]))
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = dict(zip(*(x.tolist() for x in simhash.forest(fps[near[:, 0]], fps[near[:, 1]])), strict=True))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for per in (4, 32, 1 << 15):
        got = simhash.fingerprint_links(df, per_shard=per).collect()
        a, b = (np.array([r[i] for r in got], np.int64).view(np.uint64) for i in (0, 1))
        assert dict(zip(*(x.tolist() for x in simhash.forest(a, b)), strict=True)) == want


def test_top_k(spark):
    rng = random.Random(3)
    vs = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(60)] + [(300, None), (320, [None] * 8), (340, [float("nan")] * 8), (None, [0.1] * 8), (0, None)]
    got = [tuple(r) for r in voronoi_knn.top_k(spark.createDataFrame(vs, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vs if i is not None and v and None not in v and not np.isnan(v).any()}
    want = []
    for q in sorted(x):
        if q % 20 == 0:
            best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert voronoi_knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_large_numbers_and_repeated_rows(spark):
    vs = [(0, [2.0**50, 1.0]), (1, [2.0**50, 3.0]), (2, [2.0**50, 2.0]), (3, [-(2.0**70), 1.0]), (4, [1e-3, 1.0]), (4, [1e-3, 1.0])]
    got = [tuple(r) for r in voronoi_knn.top_k(spark.createDataFrame(vs, "vec_id long, embedding array<double>"), k=4).orderBy("query_id", "rank").collect()]
    top = (1 << 63) - 1
    assert got == [(0, 1, 1, top), (0, 2, 2, top), (0, 3, 4, 64 * 64), (0, 4, 4, 64 * 64)]
    near = [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, 2.0])]
    got = [tuple(r) for r in voronoi_knn.top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 60) + 3 * 4096), (0, 2, 2, (1 << 60) + 2 * 4096)]


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]
    link = '<LINK href="{}" rel="canonical">'
    pages = [(1, "http://X.Example.com/en/1#f", ""), (2, "https://example.com/en/7?x", ""), (3, "http://ok.org/a", link.format("http://bad.com/en/q")), (4, "http://ok.org/b", link.format("/a")), (5, None, None), (6, "nonsense", "x"), (7, "http://example.com/en/77", link.format("http://bad.com/en/q")), (8, "http://far.org", '<meta http-equiv="refresh" content="0; url=http://ok.org/b">')]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[1] == ("x.example.com", "/en/1", "com/en/", "block") and got[2] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[3][2:] == (None, "block") and got[4][3] == "block" and got[8][3] == "block" and got[7][3] == "allow"
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")


@pytest.mark.parametrize("min_len,hot", [(20, 100_000), (20, 1), (20, 3), (50, 100_000)])
def test_suffix_dedup(docs, rows, none, min_len, hot):
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - min_len + 1):
            seen.setdefault(t[p : p + min_len], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            gone[i][p : p + min_len] = b"\1" * min_len
    want = sorted((r[0] if r[0] is not None else -1, len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), hashlib.sha256(bytes(c for c, x in zip(t, g, strict=True) if not x)).hexdigest()) for r, t, g in zip(rows, texts, gone, strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, min_len=min_len, family=hot).collect())
    assert got == want
    if hot > 1 and min_len == 20:
        assert suffix_dedup.dedup(none).count() == 0 and suffix_dedup.removed(docs).columns == docs.columns


def test_quality(spark, docs, rows, none):
    rng = random.Random(2)
    train = [(i, words(rng, 50) if i % 4 else "BUY!! NOW!! " * 30, "en", "s", 0, "k", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(train, DOCS), labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) and 0 <= r.score <= 1 for r in held)
    assert quality.measure(b"a b c a")[-3] == round(quality.UNIT * np.log1p(50) / 4) and quality.measure(b" ")[-3] == 0
    assert quality.classify(docs, labels).count() == len(rows) and quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_edit_embedding(docs, rows, none):
    got = edit_embedding.with_edits(docs).collect()
    order = sorted([(r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows], key=lambda x: -x[0])
    want = {}
    for k, (i, t) in enumerate(order):
        n, after = len(t) // 3, order[(k + 1) % len(order)][1]
        want.setdefault(i, set()).add((len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id if r.doc_id is not None else -(1 << 63)]
    assert next(r for r in got if r.doc_id == 8).near_edited > 0.5 > 0.2 > next(r for r in got if r.doc_id == 8).near_next
    assert edit_embedding.with_edits(none).count() == 0
    t = words(random.Random(9), 400)
    a = edit_embedding.fingerprint(t)
    assert edit_embedding.likeness(a, edit_embedding.fingerprint(t[:700] + "xx" + t[703:])) > 0.9 and a == edit_embedding.fingerprint(t)
    assert edit_embedding.likeness(a, edit_embedding.fingerprint(words(random.Random(10), 400))) < 0.2
    groups = {r.doc_id: r.group_id for r in edit_embedding.near_groups(docs).collect()}
    assert groups[0] == groups[1] == groups[2] == 0 and groups[8] == 8
