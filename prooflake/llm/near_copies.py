"""Near copies by the Jaccard likeness of word shingles, found with SimHash and vantage-point trees and with MinHash bands, and
verified on the shingles.

components() links documents whose sets of five-word shingles have a likeness of `threshold` or more and gives each its
connected component; keep_one() leaves one document of each.

How links are found. Equal sets are one node, with a 64-bit SimHash of its shingles. Fingerprints within simhash.RADIUS bits
are met by op4's routing tree of vantage points and shard trees; a forest of them, and nodes of one fingerprint, are the first
candidates. At a likeness of 0.8 fingerprints differ by about 10 bits, where such trees prune next to nothing, so that what lies
farther apart is found by bands: BANDS bands of ROWS least hashes make candidates, and at a likeness of 0.8 a pair
shares no band with a chance of (1 - 0.8**4)**32, 5e-8, and less above. First the least node of each bucket is held against
the others, which joins groups of copies at a row a member. Buckets whose members are then of several components are gone
through pair by pair, each pair in its first common band only. A bucket is dealt to blocks of about BLOCK shingles by a hash
of its members, and each two blocks meet in a task of their own, which returns a spanning forest; so a task's memory is that
of two blocks, however large the bucket. No candidate becomes a link before its shingles are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batches, connected_components, cut, hot_join, released, signed

SEED = 42
WORDS = 5
LIKE = 0.8
BANDS, ROWS = 32, 4
#: Shingles of a block of a bucket, about.
BLOCK = 1 << 19
#: Pairs whose texts a task holds beside their batch.
PAIRS = 512


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, words split at ASCII white space. Fewer words are one
    shingle; without words there is none."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    found = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def alike(common, a, b, threshold: float):
    """Whether sets of sizes a and b with so many common members have that likeness; numbers or arrays."""
    return common >= threshold * (a + b - common) - 1e-9


@cache
def _salts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * 2 + 1, rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * 2 + 1


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty, unlike between bands."""
    turns, salts = _salts()
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), 512):
        np.minimum(least, (own[None, i : i + 512] * turns).min(axis=1), out=least)
    h = ((least ^ (least >> np.uint64(32))).reshape(BANDS, ROWS) * salts).sum(axis=1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def fingerprint(own: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set: a bit is 1 if more than half of its hashes have it; 0 of an empty set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0])


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tie, key, bands, fp, size, z) for each row of docs: a hash of its text, a digest of its set, the band keys, the
    fingerprint, the number of shingles, the compressed text."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for ids, texts, ties in batches(rows, 2 << 20):
            sets = [shingles(t, words) for t in texts]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            parts = [bands(s).view(np.int64) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array([signed(fingerprint(s)) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([c.compress(t or b"") for t in texts], pa.binary())], ["doc_id", "tie", "key", "bands", "fp", "size", "z"])
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _tie(F.col("text"))).mapInArrow(run, "doc_id long, tie long, key binary, bands array<long>, fp long, size long, z binary")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst) pairs of keys to be verified, src the lesser: a key and the least one of its fingerprint, and the least ones of
    fingerprints that vantage-point trees link. nodes: (key, fp), a row for each key."""
    least = cut(nodes.groupBy("fp").agg(F.min("key").alias("least")))
    same = nodes.join(least, "fp").where("key <> least").select(F.col("least").alias("src"), F.col("key").alias("dst"))
    met = simhash.fingerprint_links(least.select("fp"), stars=False)
    met = met.join(least.select(F.col("fp").alias("src"), F.col("least").alias("a")), "src").join(least.select(F.col("fp").alias("dst"), F.col("least").alias("b")), "dst")
    return same.unionByName(met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))


def links(rows: DataFrame, threshold: float = LIKE, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(node, component) of the keys that links connect. rows: of prints()."""
    nodes = rows.select("key", "bands", "fp", "size").dropDuplicates(["key"])
    near = cut(fingerprint_pairs(cut(nodes.where("size > 0").select("key", "fp"))))
    parts = cut(nodes.select("key", F.explode("bands").alias("part")))
    shared = parts.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).where("least <> most")
    buckets = cut(parts.join(shared.select("part", "least", "n"), "part"))
    asked = buckets.select("key").union(near.select("src")).union(near.select("dst")).distinct()
    texts = cut(rows.join(asked, "key", "left_semi").select("key", "bands", "size", "z").dropDuplicates(["key"]))

    def verify(batch: Iterator) -> Iterator:
        import pyarrow as pa

        held = lru_cache(maxsize=32)(lambda z: _opened(z, words))
        for b in (whole.slice(k, PAIRS) for whole in batch for k in range(0, whole.num_rows, PAIRS)):
            pairs = ((held(x), held(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            good = [alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))
        released()

    def solve(pdf):
        import pandas as pd

        released()
        keys, part = pdf["key"].tolist(), np.array(pdf["bands"].tolist(), np.int64)
        sets = [_opened(z, words) for z in pdf["z"]]
        earlier = part[:, : int(np.argmax(part[0] == pdf["part"].iloc[0]))]
        _, comp = np.unique(np.array([c.hex() for c in pdf["component"]]), return_inverse=True)
        size = np.array([len(s) for s in sets])
        stops = np.cumsum(size)
        starts = stops - size
        members, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(members), np.int64)
        src, dst = [], []
        own, other = pdf["block"].to_numpy(), pdf["other"].to_numpy()
        cross = bool((own != other).any())
        for i in range(len(keys) - 1):
            todo = (comp != comp[i]) & alike(np.minimum(size, size[i]), size, size[i], threshold)
            if cross:
                todo &= own != own[i]
            todo[: i + 1] = False
            todo[todo] = ~(earlier[todo] == earlier[i]).any(axis=1)
            todo = np.flatnonzero(todo)
            if not len(todo):
                continue
            here = ids[starts[i] : stops[i]]
            mine[here] = 1
            if len(todo) < 16:
                common = np.array([mine[ids[starts[j] : stops[j]]].sum() for j in todo])
            else:
                common = np.add.reduceat(mine[ids], starts)[todo]
            mine[here] = 0
            for j in todo[alike(common, size[i], size[todo], threshold)].tolist():
                if comp[j] != comp[i]:
                    src.append(keys[i])
                    dst.append(keys[j])
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"src": src, "dst": dst})

    pairs = buckets.where("key <> least").select(F.col("least").alias("src"), F.col("key").alias("dst")).unionByName(near).distinct()
    pairs = pairs.join(texts.select(F.col("key").alias("src"), F.col("z").alias("z1")), "src").join(texts.select(F.col("key").alias("dst"), F.col("z").alias("z2")), "dst")
    first = cut(pairs.select("src", "dst", "z1", "z2").mapInArrow(verify, "src binary, dst binary"))
    found = cut(connected_components(first))
    # A bucket of two was one of the pairs above.
    members = buckets.where("n > 2").join(found.withColumnRenamed("node", "key"), "key", "left").select("part", "key", F.coalesce("component", "key").alias("component"))
    members = cut(members.join(texts.select("key", "size"), "key"))
    split = members.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum("size") / block).alias("blocks")).where("low <> high").select("part", "blocks")
    home = F.pmod(F.xxhash64("key", "part"), F.col("blocks"))
    met = members.join(split, "part").withColumn("block", home).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    rest = met.join(texts.select("key", "bands", "z"), "key").select("part", "low", "high", "block", "other", "key", "component", "bands", "z")
    more = cut(rest.groupBy("part", "low", "high").applyInPandas(solve, "src binary, dst binary"))
    return found if more.isEmpty() else connected_components(first.union(more))


def _opened(z: bytes, words: int) -> np.ndarray:
    import zstandard

    return shingles(zstandard.ZstdDecompressor().decompress(z), words)


def _classed(docs: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """(doc_id, tie, component, component_id) for each row of docs: tie is a hash of the text, component a key of its own."""
    rows = cut(prints(docs, words))
    nodes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = links(rows, threshold, words, block).join(nodes.withColumnRenamed("key", "node"), "node")
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(name, "component").select(F.col("node").alias("_key"), "component", "component_id")
    classes = nodes.join(linked, nodes.key == linked._key, "left").select("key", "n", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return hot_join(rows.select("doc_id", "tie", "key"), classes, "key").select("doc_id", "tie", "component", "component_id")


def components(docs: DataFrame, threshold: float = LIKE, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row of docs; component_id is the least doc_id of the component.

    Null texts and texts without words are alike and like no others. Rows with a null doc_id take part in links; a component
    of only such rows has a null component_id. Repeated rows stay. An empty table gives no rows.
    """
    return _classed(docs, threshold, words, block).select("doc_id", "component_id")


def keep_one(docs: DataFrame, threshold: float = LIKE, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """docs with one document of each group of near copies: that of the least doc_id, and of those the least hash of the text,
    so that rows of one doc_id with other texts are documents of their own.

    Documents without an id are kept, since no other document stands for them. Of repeated rows one stays.
    """
    first = _classed(docs.where("doc_id is not null"), threshold, words, block).groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie"))
    own = docs.where("doc_id is not null")
    met = own.join(first, (own.doc_id.cast("long") == first._id) & (_tie(own.text) == first._tie), "left_semi")
    return met.withColumn("_text_tie_", _tie(F.col("text"))).dropDuplicates(["doc_id", "_text_tie_"]).drop("_text_tie_").unionByName(docs.where("doc_id is null"))


def _tie(text) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
