"""SimHash near-duplicates, found with vantage-point trees.

fingerprints() makes a 64-bit SimHash of each whole text; components() links fingerprints at Hamming distance `radius`
or less and gives each its connected component.

How links are found. Equal fingerprints are one node, so groups of copies cost one row. A routing tree of vantage points,
grown on the driver from a bounded sample, splits the fingerprints into shards: each goes home to one shard, and queries
go along to every shard that its ball of `radius` overlaps, by the triangle bounds |d(x, v) - mu| <= radius. A ball
overlaps more and more shards as a tree gets deeper, so the routing tree keeps one depth at every size (about 3.6 copies of
a fingerprint), and a shard that would grow beyond `per_shard` is dealt to cells by radius + 1 blocks of bits, of which near
fingerprints have one in common. Inside a cell a second tree prunes alike down to small leaves, which are compared in
blocks. A cell returns a spanning forest of its links, not its pairs, so that a dense group of near copies gives as many
rows as it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, connected_components, cut, hot_join, signed

SEED = 42
WORDS = 3
RADIUS = 3
#: Fingerprints that the driver sees, to choose vantage points.
SAMPLE = 4096
#: Depth of the routing tree, and fingerprints of a cell, about.
DEPTH, PER_SHARD = 4, 32768
LEAF = 256


def simhash(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text in UTF-8: A-Z lower-cased, words split at ASCII white space, shingles of `words`
    with repeats; a bit is 1 if more than half of the hashes have it. Without words it is 0."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - words + 1
    cuts = map(slice, starts[:n].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in map(joined.__getitem__, cuts)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(part), 255):  # sums of bytes that cannot overflow are the fast ones
            ones += np.add.reduce(part[k : k + 255], axis=0, dtype=np.uint8)
    return int(sum(1 << b for b in range(64) if 2 * ones[b] > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row of docs, repeated rows included. A null text has no words: fp 0."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([signed(simhash(t)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- vantage-point trees -------------------------------------------------------------------------------------------


def grow(sample: np.ndarray, depth: int) -> list | int:
    """A routing tree over a sample: [vantage, mu, inner, outer], or at its ends the shard's number."""
    count = iter(range(1 << 30))

    def node(part: np.ndarray, left: int) -> list | int:
        if left and len(part) >= 4:
            v = part[len(part) // 2]
            d = np.bitwise_count(part ^ v)
            mu = int(np.median(d))
            inner = d <= mu
            if inner.all() and mu:
                mu, inner = mu - 1, d <= mu - 1
            if inner.any() and not inner.all():
                return [int(v), mu, node(part[inner], left - 1), node(part[~inner], left - 1)]
        return next(count)

    return node(np.asarray(sample, np.uint64), depth)


def route(tree: list | int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index into fps, home?). Of a pair of different shards one is a query where the other is at home: the query
    goes from the inner to the outer side of the split that parts them."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def down(at: list | int, ix: np.ndarray, home: np.ndarray) -> None:
        if not len(ix):
            return
        if isinstance(at, int):
            out.append((at, ix, home))
            return
        v, mu, inner, outer = at
        d = np.bitwise_count(fps[ix] ^ np.uint64(v)).astype(np.int64)
        own = d <= mu
        to_in = own & home | ~home & (d - radius <= mu)
        to_out = np.where(home & ~own, True, d + radius > mu)
        down(inner, ix[to_in], home[to_in])
        down(outer, ix[to_out], (home & ~own)[to_out])

    down(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([np.full(len(i), s) for s, i, _ in out]), np.concatenate([i for _, i, _ in out]), np.concatenate([h for _, _, h in out])


def links(homes: np.ndarray, others: np.ndarray, radius: int, leaf: int = LEAF, stars: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what the pairs within `radius` connect, of homes with homes and with others: stars around a
    root, else pairs at most twice the radius apart."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def block(h: np.ndarray, q: np.ndarray) -> None:
        for i in range(0, len(q), 4096):
            part = q[i : i + 4096]
            col, row = np.nonzero(np.bitwise_count(part[:, None] ^ h[None, :]) <= radius)
            if not len(col):
                continue
            first = np.concatenate(([True], col[1:] != col[:-1]))
            left.append(part[col[first]])
            right.append(h[row[first]])
            if not first.all():  # homes that share a query hang together
                pairs = np.unique(row[:-1][~first[1:]] * len(h) + row[1:][~first[1:]])
                left.append(h[pairs // len(h)])
                right.append(h[pairs % len(h)])

    stack = [(homes, np.concatenate([homes, others]))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > leaf:
            v = h[len(h) // 2]
            d = np.bitwise_count(h ^ v)
            mu = int(np.median(d))
            inner = d <= mu
            if inner.all() and mu:
                mu, inner = mu - 1, d <= mu - 1
            if inner.any() and not inner.all():
                to = np.bitwise_count(q ^ v).astype(np.int64)
                stack.append((h[inner], q[to - radius <= mu]))
                stack.append((h[~inner], q[to + radius > mu]))
                continue
            for i in range(0, len(h), leaf):
                block(h[i : i + leaf], q)
            continue
        block(h, q)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    differ = a != b
    return forest(a[differ], b[differ], stars)


def forest(a: np.ndarray, b: np.ndarray, stars: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same components as (node, root) edges, one for each node that is no root, or as many of the given edges."""
    if not len(a):
        return a, b
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    x, y = ix[: len(a)], ix[len(a) :]
    pairs = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip((pairs // len(nodes)).tolist(), (pairs % len(nodes)).tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            kept.append(k)
    if not stars:
        return nodes[pairs[kept] // len(nodes)], nodes[pairs[kept] % len(nodes)]
    roots = np.array([root(i) for i in range(len(nodes))])
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, per_shard: int = PER_SHARD, stars: bool = True) -> DataFrame:
    """(src, dst) edges that connect what pairs of distinct fingerprints within `radius` connect, as links() gives them. fps:
    column fp."""
    n = fps.count()
    width = 64 // (radius + 1)
    bits = min(width, max(0, math.ceil(math.log2(max(1, n / per_shard))) - DEPTH))
    seen = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    tree = grow(np.array(seen, np.int64).view(np.uint64), DEPTH)

    def send(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            x = b.column(0).to_numpy(zero_copy_only=False)
            shard, ix, home = route(tree, x.view(np.uint64), radius)
            for block in range(radius + 1 if bits else 1):
                part = (x[ix].view(np.uint64) >> np.uint64(block * width)) & np.uint64((1 << bits) - 1)
                cell = (shard * (radius + 1) + block << bits) + part.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(x[ix], pa.int64()), pa.array(home)], ["cell", "fp", "home"])

    def solve(pdf):
        import pandas as pd

        x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        home = pdf["home"].to_numpy(bool)
        a, b = links(x[home], x[~home], radius, stars=stars)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return fps.select("fp").mapInArrow(send, "cell long, fp long, home boolean").groupBy("cell").applyInPandas(solve, "src long, dst long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the least doc_id of the component.

    Null texts and texts without words have fingerprint 0 and link like any other. Rows with a null doc_id take part in
    links; a component of only such rows has a null component_id. Repeated rows stay. An empty table gives no rows.
    """
    fp = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(fingerprint_links(nodes, radius))
    named = parts.join(nodes, parts.node == nodes.fp).select("fp", "component", "least")
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(name, "component").select(F.col("fp").alias("_fp"), "component_id")
    classes = nodes.join(linked, nodes.fp == linked._fp, "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return hot_join(fp, classes, "fp").select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
