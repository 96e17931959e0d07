"""Document fingerprints by randomised edit embedding.

A random walk reads a text: at step j it writes the character it stands on and goes on to the next one if the shared
random bit h(j, character) is 1. Walks of two texts that meet after an edit go on together, so the edit distance of texts
becomes a Hamming distance of what is written. A fingerprint samples SLOTS places of the writing; slot b samples the place
of least keyed rank, so texts of unlike length sample the same places as far as both reach. Each sampled place gives 8
bits of a hash of the characters that follow it. Likeness is the share of equal slots.

Bands of slots find candidates (near_groups), and likeness verifies them.

Random bits depend on j modulo PERIOD and on a class of characters (256), so that the walk is a table of PERIOD states;
hashes of samples use the characters themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, released

SEED = 10
PERIOD = 2048
SLOTS = 128
#: Characters hashed at a sampled place.
REACH = 6
#: Bytes of text in a range of ids, about.
RANGE = 32 << 20
#: Where a state holds its step.
PERIOD_AT = 256
BANDS = 16
LIKE = 0.8
#: Rows whose texts a task holds beside their batch.
ROWS = 512


@cache
def _walk(seed: int) -> list[list]:
    """States of the walk: state[c] is the state after character class c, state[256] the step modulo PERIOD."""
    bits = np.random.default_rng(seed).integers(0, 2, (256, PERIOD)).astype(bool)
    bits[:, 0] |= ~bits.any(axis=1)
    states: list[list] = [[] for _ in range(PERIOD)]
    after = np.empty((256, PERIOD), np.int64)
    for c in range(256):
        ones = np.flatnonzero(bits[c])
        at = np.searchsorted(ones, np.arange(PERIOD))
        after[c] = (ones[at % len(ones)] + 1) % PERIOD
    for j, state in enumerate(states):
        state += [states[k] for k in after[:, j].tolist()]
        state.append(j)
    return states


@cache
def _places(seed: int) -> np.ndarray:
    """Row b: the places at which the least rank so far of slot b changes, as far as 2**48."""
    rng = np.random.default_rng([seed, 1])
    rows = []
    for _ in range(SLOTS):
        at, least, row = 0, rng.random(), [0]
        while at < 1 << 48:
            at += int(min(rng.geometric(max(least, 1e-18)), 1 << 60))
            least *= rng.random()
            row.append(at)
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [1 << 62] * (width - len(r)) for r in rows])


@cache
def _salts(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, 2])
    return rng.integers(1, 1 << 63, REACH, np.uint64) * 2 + 1, rng.integers(1, 1 << 63, SLOTS, np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _states(points: np.ndarray, start: list) -> tuple[list, np.ndarray]:
    """The walk's last state, and after each character the step modulo PERIOD."""
    kinds = np.where(points < 128, points, 128 + points % 127).astype(np.uint8).tobytes()
    seen = list(accumulate(kinds, getitem, initial=start))
    return seen[-1], np.fromiter(map(itemgetter(PERIOD_AT), seen), np.int64, len(seen))


def _sampled(points: np.ndarray, steps: np.ndarray, seed: int) -> bytes:
    """The fingerprint of a text whose walk had these steps (one more than it has characters)."""
    if not len(points):
        return bytes(SLOTS)
    moved = np.diff(steps) % PERIOD
    moved[moved == 0] = PERIOD
    until = np.cumsum(moved)
    places = _places(seed)
    own = places[np.arange(SLOTS), (places < until[-1]).sum(axis=1) - 1]
    at = np.searchsorted(until, own, side="right")
    padded = np.concatenate((points, np.zeros(REACH, np.uint32))).astype(np.uint64) + np.uint64(1)
    weights, salts = _salts(seed)
    h = (padded[at[:, None] + np.arange(REACH)] * weights).sum(axis=1) ^ salts
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprint(text: str, seed: int = SEED) -> bytes:
    """SLOTS bytes; zeros for the empty text."""
    points = _points(text)
    return _sampled(points, _states(points, _walk(seed)[0])[1], seed)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, 0 to 1."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def shared_bands(a: bytes, b: bytes, bands: int = BANDS) -> int:
    rows = (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).reshape(bands, -1)
    return int(rows.all(axis=1).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, fp binary) for each row of docs; a null text is empty."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or "", seed) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def near_groups(docs: DataFrame, threshold: float = LIKE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, group_id): documents that links of likeness `threshold` or more connect, group_id the least doc_id.

    Equal fingerprints are one node. There are more bands than a pair of likeness `threshold` can have unequal slots, so each
    such pair agrees in a band. In a band's bucket each is compared with all that are not connected to it yet, and the links
    are a spanning forest, so that a bucket of near copies gives as many rows as it has members. Rows with a null doc_id keep
    a null group unless linked to others.
    """
    fp = cut(fingerprints(docs, id_col, text_col, seed))
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    unequal = SLOTS - math.ceil(threshold * SLOTS - 1e-9)
    width = max(1, SLOTS // (unequal + 1))
    bands = SLOTS // width
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.substring("fp", 1 + i * width, width) for i in range(bands)])).alias("band", "part"))

    def verify(pdf):
        import pandas as pd

        own = sorted(pdf["fp"])
        slots = np.array([np.frombuffer(x, np.uint8) for x in own])
        part = np.arange(len(own))
        src, dst = [], []
        for i in range(len(own) - 1):
            rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
            for j in rest[(slots[rest] == slots[i]).mean(axis=1) >= threshold].tolist():
                if part[j] != part[i]:
                    src.append(own[i])
                    dst.append(own[j])
                    part[part == part[j]] = part[i]
        return pd.DataFrame({"src": src, "dst": dst})

    links = keyed.groupBy("band", "part").applyInPandas(verify, "src binary, dst binary")
    parts = connected_components(links.select(F.hex("src").alias("src"), F.hex("dst").alias("dst")))
    named = parts.join(nodes.select(F.hex("fp").alias("node"), "least"), "node")
    names = named.join(named.groupBy("component").agg(F.min("least").alias("group_id")), "component").select("node", "group_id")
    classes = nodes.select("fp", F.hex("fp").alias("node"), "least").join(names, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("group_id", "least").alias("group_id"))
    return fp.join(classes, fp.fp == classes._fp).select("doc_id", "group_id")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next,
    bands_edited, bands_next.

    The edited text has its last floor(n/3) code points replaced by the first as many of the next document. Next means by
    descending id, nulls last, equal ids by a hash of the text; after the last comes the first. Texts are dealt once, by
    ranges of ids, of RANGE bytes about; the first document of each range also goes to the range before it, so one task never
    sees more than its range. A null text is empty. A single document is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    cuts = np.array(sorted({int(x) for x in rows.select("id").approxQuantile("id", [i / n for i in range(1, n)], min(0.002, 0.25 / n))}) if n > 1 else [], np.int64)
    tops = _tops(rows, cuts)
    beyond: dict[int, list[int]] = {}
    for k, (bucket, _) in enumerate(tops):
        beyond.setdefault(tops[(k + 1) % len(tops)][1], []).append(bucket)

    def deal(batch: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in (whole.slice(k, ROWS) for whole in batch for k in range(0, whole.num_rows, ROWS)):
            ids, texts = b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            home = np.searchsorted(cuts, np.array(ids, np.int64), side="right").tolist()
            z = [c.compress(t) for t in texts]
            ix = [(h, False, i) for i, h in enumerate(home)]
            ix += [(to, True, i) for i, x in enumerate(ids) if x in beyond for to in beyond[x]]
            pick = [i for _, _, i in ix]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _, _ in ix], pa.int32()), pa.array([g for _, g, _ in ix]), b.column(0).take(pa.array(pick, pa.int64())), b.column(1).take(pa.array(pick, pa.int64())), pa.array([z[i] for i in pick], pa.binary())], ["bucket", "guest", "id", "tie", "z"]
            )
        released()

    def run(batch: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        start = _walk(seed)[0]
        held = None
        out: list[tuple] = []
        for b in (whole.slice(k, ROWS) for whole in batch for k in range(0, whole.num_rows, ROWS)):
            for bucket, guest, id_, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if guest and (held is None or held[0] != bucket):
                    continue  # a further row of the same id as the guest
                text = d.decompress(z).decode("utf-8", "replace")
                points = _points(text)
                _, steps = _states(points, start)
                own = _sampled(points, steps, seed)
                if held is not None and held[0] == bucket:
                    out.append(_row(*held[1:], points, own, seed))
                held = None if guest else (bucket, id_, points, steps, own)
                if len(out) >= 500:
                    yield _arrow(out)
                    out = []
        if out:
            yield _arrow(out)
        released()

    def _row(id_: int, points: np.ndarray, steps: np.ndarray, own: bytes, after: np.ndarray, after_print: bytes, seed: int) -> tuple:
        n = len(points)
        gone = n // 3
        tail = after[:gone]
        edited = np.concatenate((points[: n - gone], tail))
        kept = steps[: n - gone + 1]
        more = _states(tail, _walk(seed)[int(kept[-1])])[1]
        new = _sampled(edited, np.concatenate((kept, more[1:])), seed)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return (None if id_ == low else id_, n, digest, own.hex(), new.hex(), likeness(own, new), likeness(own, after_print), shared_bands(own, new), shared_bands(own, after_print))

    def _arrow(out: list[tuple]):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    dealt = rows.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(deal, "bucket int, guest boolean, id long, tie long, z binary")
    ordered = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("id"), "tie")
    return ordered.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long"


def _tops(rows: DataFrame, cuts: np.ndarray) -> list[tuple[int, int]]:
    """(bucket, greatest id) of the buckets that have rows, in descending order; as many at most as there are cuts."""

    def most(batch: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batch:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if len(ids):
                home = np.searchsorted(cuts, ids, side="right")
                found = np.unique(home)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([int(ids[home == h].max()) for h in found], pa.int64())], ["bucket", "id"])

    got = rows.select("id").mapInArrow(most, "bucket int, id long").groupBy("bucket").agg(F.max("id").alias("id")).collect()
    return sorted(((r["bucket"], r["id"]) for r in got), reverse=True)
