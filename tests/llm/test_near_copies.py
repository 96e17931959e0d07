"""The pipeline's near-copies stage against brute force on five-word shingles."""

import random

import corpus_pipeline
from prooflake.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, threshold=0.8):
    """Least index of each one's component."""
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def cases():
    rng = random.Random(7)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(60):  # copies with 1 to 6 words replaced, on both sides of 0.8
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for n in range(1, 7):
            w = list(base)
            for k in rng.sample(range(len(w)), n):
                w[k] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    for _ in range(3):  # families that drift: neighbours are alike, ends are not
        w = [f"d{rng.randrange(3000)}" for _ in range(200)]
        for step in range(30):
            w[step * 6] = f"step{step}-{rng.randrange(10**6)}"
            w[step * 6 + 3] = f"step{step}-{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


def test_near_dedup_stage(spark):
    texts = cases()
    comp = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(comp))


def test_components(spark):
    texts = cases()[:150]
    comp = brute(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, texts[5], None, None, 0), (None, "no other like this one", None, None, 0)], DOCS)
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in near_copies.components(docs).collect())
    assert got == sorted([*enumerate(comp), (3, comp[3]), (-1, comp[5]), (-1, -1)])
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert near_copies.components(docs.limit(0)).count() == 0


def test_blocks_of_a_bucket(spark):
    """Buckets dealt to many blocks give the same components."""
    texts = cases()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = dict(r for r in near_copies.components(docs, block=600).collect())
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_one_id_of_two_texts(spark):
    """A row is told by its id and text: the near copy of another document goes, the text that is like no other stays."""
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"u{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (5, text, "en", "s", 0), (5, other, "en", "s", 0), (5, other, "en", "s", 0)], DOCS)
    assert sorted((r.doc_id, r.text) for r in near_copies.keep_one(docs).collect()) == [(1, text), (5, other)]


def test_fingerprint_pairs(spark):
    """Fingerprints against plain Python, and every text that has another within the trees' radius is met by a pair."""
    texts = [t for t in cases() if t and t.split()]
    rows = near_copies.prints(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)).collect()
    for r in rows[:40]:
        hashes = near_copies.shingles(texts[r.doc_id].encode()).tolist()
        assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    fps = {bytes(r.key): r.fp & (1 << 64) - 1 for r in rows}
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame([(r.key, r.fp) for r in {bytes(r.key): r for r in rows}.values()], "key binary, fp long")).collect()
    assert pairs and all(bytes(p.src) < bytes(p.dst) and (fps[bytes(p.src)] ^ fps[bytes(p.dst)]).bit_count() <= 6 for p in pairs)
    near = {a for a in fps for b in fps if a != b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert near <= {bytes(x) for p in pairs for x in p}
