"""Mixing sources to target weights.

Each source's documents are one stream of words, cut into blocks of fixed length. The mix is a row of output shards with a
fixed number of slots. Each shard draws its count of every source from a multinomial over what the sources still owe to
their targets, so that totals are met without being dealt out beforehand. A source's slots are numbered through the shards;
slot k takes block perm(k mod blocks) of pass k div blocks, where perm is a keyed Feistel permutation of the source's block
numbers for that pass, so that no block is taken twice before all are taken once. Inside a shard a permutation of its own
gives each slot its position. Slots and blocks meet by (source, block): packed() gives the shards' blocks, taken() and
mixed() what each document has in them.

Streams need no global order: documents are dealt to `buckets` per source by a hash of their content, running sums are made
inside buckets, and the few sums of buckets are added up, so that a source with a third of all rows is spread like any
other. Nothing depends on how the input is partitioned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, frugal

PATTERN = (5, 2, 1)
CAP = 3
SEED = 3
#: Words of a block, and slots of an output shard.
BLOCK, SHARD = 128, 1 << 16
#: Texts that a task holds at once.
PASSES = 512
#: Sources up to which their table is broadcast; a longer one is joined by a shuffle.
SOURCES = 100_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: dict, share: float = 1.0, pattern: tuple = PATTERN, cap: float = CAP) -> dict:
    """Words to take of each source. Sources by code point, null last, weigh pattern[0], pattern[1], ... over and over and
    share `share` of all words by weight; what passes cap times a source's size is shared among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(order)}
    rest, out = share * sum(sizes.values()), dict.fromkeys(order, 0.0)
    free = [s for s in order if sizes[s] > 0]
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > cap * sizes[s]]
        if not full:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = float(cap * sizes[s])
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def permuted(k: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """Places of k under a pseudorandom permutation of 0 .. n-1: four Feistel rounds, walked until they fall below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), np.random.default_rng(key).integers(1, 1 << 63, 4, np.uint64)
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in keys:
            h = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) >> np.uint64(20) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs with uid, place (a hash of doc_id, source and text, which orders documents) and size (words); the text is
    dropped, or kept compressed as z. Checkpointed, so that uid stays."""
    docs = docs.withColumn("place", F.xxhash64("doc_id", "source", F.col("text").cast("string")))
    rest = [c for c in docs.columns if c != "text"]
    kinds = docs.select(*rest).schema
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in rows:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            cols = [*b.columns[1:], pa.array([len((t or b"").split()) for t in texts], pa.int64())]
            if with_text:
                cols.append(pa.array([c.compress(t or b"") for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*rest, "size", "z"][: len(cols)])

    text = F.col("text").cast("string")
    out = docs.select(text.alias("text"), *rest).mapInArrow(frugal(run), f"{shape}, size long" + ", z binary" * with_text)
    return cut(out.withColumn("uid", F.monotonically_increasing_id()))


def draws(owed: np.ndarray, shard: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard number, count of each source) of output shards of `shard` slots, the last one shorter. A shard draws from a
    multinomial whose weights are the slots that sources still owe; what passes a source's due is drawn again for the others."""
    left = owed.astype(np.int64).copy()
    for s in range(-(-int(left.sum()) // shard)):
        rng, count = np.random.default_rng([seed, s]), np.zeros(len(left), np.int64)
        todo = min(shard, int(left.sum()))
        while todo:
            open_ = left - count
            got = np.minimum(rng.multinomial(todo, open_ / open_.sum()), open_)
            count += got
            todo -= int(got.sum())
        left -= count
        yield s, count


def plan(sizes: DataFrame, share: float = 1.0, pattern: tuple = PATTERN, cap: int = CAP, block: int = BLOCK, seed: int = SEED, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (uid, place, source, size): the sources (src, source, source_size, target), the slots of the output shards (shard,
    position, src, block, pass), and which words of a document, counted from its first, lie in which block (uid, src, block,
    start, words). The table of sources is made on the driver; it has a row for each source."""
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total = {r["source"]: r["size"] for r in sums}
    target = targets(total, share, pattern, cap)
    rows = []
    for i, (s, t) in enumerate(target.items()):
        blocks = -(-total[s] // block)
        slots = min(round(t * blocks / total[s]), cap * blocks) if blocks else 0
        rows.append((i, s, total[s], t, blocks, slots))
    table = spark.createDataFrame([r[:4] for r in rows], "src int, source string, source_size long, target double")
    if len(rows) <= SOURCES:
        table = F.broadcast(table)
    blocks, owed = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)

    def draw(batch: Iterator) -> Iterator:
        import pandas as pd

        for _ in batch:
            first = np.zeros(len(owed), np.int64)
            for s, count in draws(owed, shard, seed):
                own = np.flatnonzero(count)
                yield pd.DataFrame({"src": own, "shard": s, "size": count.sum(), "base": (np.cumsum(count) - count)[own], "first": first[own], "n": count[own], "blocks": blocks[own]})
                first += count

    def take(batch: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batch:
            for r in pdf.itertuples():
                for at in range(0, r.n, 1 << 18):
                    j = np.arange(at, min(at + (1 << 18), r.n))
                    turn, own = (r.first + j) // r.blocks, (r.first + j) % r.blocks
                    for e in np.unique(turn).tolist():
                        own[turn == e] = permuted(own[turn == e], r.blocks, [seed, r.src, e])
                    yield pd.DataFrame({"shard": r.shard, "position": permuted(r.base + j, r.size, [seed, 1 << 40, r.shard]), "src": r.src, "block": own, "pass": turn})

    drawn = spark.range(1, numPartitions=1).mapInPandas(draw, "src int, shard long, size long, base long, first long, n long, blocks long")
    slots = drawn.repartition("src", "shard").mapInPandas(take, "shard long, position long, src int, block long, pass long")

    buckets = max(1, math.isqrt(sum(r["n"] for r in sums)))
    own = sizes.where("size > 0").join(table.select("src", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    own = own.select("uid", "place", "src", "size", F.pmod("place", F.lit(buckets)).alias("bucket"))
    offset = own.groupBy("src", "bucket").agg(F.sum("size").alias("all")).withColumn("offset", F.sum("all").over(W.partitionBy("src").orderBy("bucket")) - F.col("all"))
    run = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("place", "uid")) - F.col("size")
    placed = own.withColumn("run", run).join(offset.select("src", "bucket", "offset").hint("merge"), ["src", "bucket"]).select("uid", "src", "size", (F.col("run") + F.col("offset")).alias("at"))
    parts = placed.select("uid", "src", "size", "at", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    inside = parts.withColumn("start", F.greatest(F.lit(0), F.col("block") * block - F.col("at"))).withColumn("stop", F.least("size", (F.col("block") + 1) * block - F.col("at")))
    return table, slots, inside.select("uid", "src", "block", "start", (F.col("stop") - F.col("start")).alias("words"))


def _used(slots: DataFrame, inside: DataFrame) -> DataFrame:
    """(uid, start, words, times): how often the words of a document's blocks are in the mix."""
    times = slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    return inside.join(times.hint("merge"), ["src", "block"]).select("uid", "start", "words", "times")


def packed(docs: DataFrame, **options) -> DataFrame:
    """The blocks of the output shards: (shard, position, source, block, pass, n_words, text), text being the block's words,
    joined by spaces. Positions of a shard are 0, 1, ...; all blocks but a source's last have the block's full length.

    A null text has no words; an empty table gives no rows."""
    base = sized(docs.select("text", "doc_id", F.col("source").cast("string").alias("source")), with_text=True)
    table, slots, inside = plan(base.select("uid", "place", "source", "size"), **options)
    runs = inside.groupBy("uid").agg(F.collect_list(F.struct("src", "block", "start", "words")).alias("runs"))

    def cut_out(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in rows:
            for uid, place, z, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = d.decompress(z).split()
                parts = [b" ".join(words[r["start"] : r["start"] + r["words"]]) for r in own]
                cols = [[r["src"] for r in own], [r["block"] for r in own], [(place, uid, r["words"], t.decode("utf-8", "replace")) for r, t in zip(own, parts, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array([dict(zip(("place", "uid", "words", "text"), x, strict=True)) for x in cols[2]], pa.struct([("place", pa.int64()), ("uid", pa.int64()), ("words", pa.int64()), ("text", pa.string())]))], ["src", "block", "part"])

    parts = base.join(runs, "uid").select("uid", "place", "z", "runs").mapInArrow(cut_out, "src int, block long, part struct<place: bigint, uid: bigint, words: bigint, text: string>")
    whole = parts.groupBy("src", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # a block holds at most its words' number of parts
    text = F.concat_ws(" ", F.transform("parts", lambda p: p["text"]))
    whole = whole.select("src", "block", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("n_words"), text.alias("text"))
    return slots.join(whole, ["src", "block"]).join(table.select("src", "source"), "src").select("shard", "position", "source", "block", "pass", "n_words", "text")


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words of it in the mix, repeats counted).

    A null text has no words; a null source is a source of its own; repeated rows are documents of their own. No document
    gives more than `cap` times its size. An empty table gives no rows."""
    sizes = sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"))
    table, slots, inside = plan(sizes, **options)
    used = _used(slots, inside)
    sums = used.groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = sizes.join(sums, "uid", "left").join(table.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each pass that takes words of a document, its text the
    words taken in that pass. A pass that takes all words keeps the text as it is; n_chars, if there, is set anew.
    Documents without words (null and empty texts) have no rows, bytes that aren't UTF-8 become U+FFFD, an empty table gives no
    rows, repeated rows are documents of their own."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]  # so that no name clashes
    base = sized(docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), *own), with_text=True)
    _, slots, inside = plan(base.select("uid", "place", "source", "size"), **options)
    runs = _used(slots, inside).groupBy("uid").agg(F.collect_list(F.struct("start", "words", "times")).alias("runs"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema} | {"text": "string"}

    def cut_out(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in (whole.slice(k, PASSES) for whole in rows for k in range(0, whole.num_rows, PASSES)):
            texts, pick = [], []
            for i, (z, size, runs_) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                whole = d.decompress(z)
                for e in range(max(r["times"] for r in runs_)):
                    spans = _joined([(r["start"], r["start"] + r["words"]) for r in runs_ if r["times"] > e])
                    texts.append((whole if spans == [(0, size)] else _words(whole, spans)).decode("utf-8", "replace"))
                    pick.append(i)
            left = b.take(pa.array(pick, pa.int64()))
            cols = dict(zip(rest, left.columns[3:], strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(map(len, texts), pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return base.join(runs, "uid").select("z", "size", "runs", *[f"c{i}" for i in range(len(rest))]).mapInArrow(frugal(cut_out), ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Words spans[i] of a text with the white space inside them, spans joined by a space."""
    at = [m.span() for m in _WORD.finditer(text)]
    return b" ".join(text[at[a][0] : at[b - 1][1]] for a, b in spans)
