"""The mix by output shards: draws, positions and blocks recomputed in plain Python."""

from collections import Counter, defaultdict

import numpy as np

from prooflake.llm import mixing
from prooflake.llm.common import cut

DOCS = "doc_id long, text string, source string"


def corpus(spark):
    rows = [(i, " ".join(f"{'abc'[i % 3]}{i}-{k}" for k in range(5 + i * 7 % 40)), "abc"[i % 3]) for i in range(120)]
    return rows, spark.createDataFrame([*rows, (500, None, "a"), (501, " ", None)], DOCS)


def test_draws_meet_their_totals():
    owed = np.array([7000, 40, 1, 0, 2500])
    got = list(mixing.draws(owed, 500, 3))
    counts = np.array([c for _, c in got])
    assert [s for s, _ in got] == list(range(20)) and counts.sum(axis=0).tolist() == owed.tolist()
    assert counts.sum(axis=1).tolist() == [500] * 19 + [41]
    share = counts[:10, 0] / 500  # a binomial's spread, neither constant nor wider
    assert 0.005 < share.std() < 0.05 and abs(share.mean() - 7000 / 9541) < 0.03


def test_packed_blocks(spark):
    rows, docs = corpus(spark)
    block, shard = 16, 10
    got = sorted(mixing.packed(docs, block=block, shard=shard).collect(), key=lambda r: (r.shard, r.position))
    # the streams of words, in the order that documents are dealt
    sizes = {r.doc_id: r["size"] for r in mixing.taken(docs, block=block, shard=shard).collect()}
    total = Counter()
    for i, _, s in rows:
        total[s] += sizes[i]
    target = mixing.targets(dict(total))
    names = sorted(total)
    blocks = {s: -(-total[s] // block) for s in names}
    slots = {s: min(round(target[s] * blocks[s] / total[s]), 3 * blocks[s]) for s in names}
    want, first = [], Counter()
    for number, count in mixing.draws(np.array([slots[s] for s in names] + [0]), shard, mixing.SEED):
        base = 0
        for src, s in enumerate(names):
            for j in range(int(count[src])):
                k = first[s] + j
                at = mixing.permuted(np.array([base + j]), int(count.sum()), [mixing.SEED, 1 << 40, number])[0]
                turn = k // blocks[s]
                want.append((number, at, s, mixing.permuted(np.array([k % blocks[s]]), blocks[s], [mixing.SEED, src, turn])[0], turn))
            first[s] += int(count[src])
            base += int(count[src])
    assert [(r.shard, r.position, r.source, r.block, r["pass"]) for r in got] == sorted(want)
    assert max(r.shard for r in got) > 3
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    # each block has its words once, whatever pass, and blocks of a source share none
    texts = {(r.source, r.block): r.text.split() for r in got}
    assert all(texts[r.source, r.block] == r.text.split() and len(r.text.split()) == r.n_words <= block for r in got)
    seen = [w for t in texts.values() for w in t]
    assert len(seen) == len(set(seen))
    # what documents give is what the blocks hold
    words = Counter(w for r in got for w in r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.taken(docs, block=block, shard=shard).collect()}
    for i, text, _ in rows:
        assert taken[i] == sum(words[w] for w in text.split())
    assert taken[500] == taken[501] == 0


def test_packed_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.packed(docs).count() == 0
    assert cut(mixing.packed(spark.createDataFrame([(1, None, None)], DOCS))).count() == 0
