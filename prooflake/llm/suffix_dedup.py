"""Removal of repeated byte strings by prefix-free parsing.

Every byte covered by a `min_len`-byte string that also starts anywhere else goes. The work per text:

1. Triggers. A rolling hash of GRAM bytes is taken everywhere; a place is a trigger if its hash is the leftmost least of
   the first `reach` places of some min_len-byte string. So each such string holds a trigger, set by its own bytes alone,
   and triggers cut texts into phrases of bounded length whose cut does not depend on where they stand.
2. Filter. A string that repeats has the same bytes after its trigger up to its shortest end. Hashes of those bytes are
   counted over the corpus (partial sums first); a trigger whose hash stands alone can't be in a repeat.
3. Order. The other triggers send their context: the end of the phrase before (the dictionary) and the bytes after (the
   parse). Equal contexts are merged before they are sent. Of the triggers of one family, two orders are made: of
   the phrase ends read backwards, and of the parse suffixes, each with the lengths of common prefixes of neighbours. A
   string is a pair of a class of the first order and a class of the second; repeats are pairs that occur twice. Bytes
   are compared here, so hashes of step 2 only filter.
4. Spans are united per text and cut out.

Texts are handled once per distinct text; of a text that occurs twice, all strings repeat. The contexts of a family with
more than `family` triggers are merged first: of a context that occurs twice all strings repeat, and one row of it stands for
all. Are there still more than `family` contexts, the family is split: the strings of the nearer and of the farther half of
starts left of the trigger become families of their own, each by the hash of the longer window that all its strings share,
and so on, down to single strings, which are one context. So no task orders more than `family` contexts of one family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal, hot_join

MIN_LEN = 200
#: Places searched for a trigger at the head of a string.
REACH = 150
GRAM = 16
#: Contexts of a family that is ordered in one task.
FAMILY = 10_000
#: Contexts merged in a task before they are sent, and contexts ordered at once.
MERGE, ORDER = 10_000, 10_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash's base, of its inverse, and a value for each byte."""
    have = _tables.__dict__.get("have")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        up = np.cumprod(np.full(size, _BASE, np.uint64))
        down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
        have = (up, down, np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) * 2 + 1)
        _tables.__dict__["have"] = have
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Windows:
    """Rolling hashes of any windows of a buffer, from sums of its prefixes."""

    def __init__(self, buf: np.ndarray):
        up, self.down, value = _tables(len(buf) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[buf] * up[: len(buf)])))

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def shared(self, t: np.ndarray, reach: int, min_len: int) -> np.ndarray:
        """For triggers at t: the hash of what all strings that start 0 .. reach - 1 bytes left of them have after them."""
        return self(t, t + min_len - reach + 1)


def triggers(buf: np.ndarray, ends: np.ndarray, min_len: int, reach: int, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after another in buf and end at `ends`: for each trigger its place, and the first and last
    start of the strings it stands for."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none
    gram = min(GRAM, min_len - reach + 1)
    h = windows(slice(0, n - gram + 1), slice(gram, n + 1))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = -(-len(key) // reach) * reach
    rows = np.full(width + reach, _MASK, np.uint64)
    rows[: len(key)] = key
    rows = rows.reshape(-1, reach)
    after = np.minimum.accumulate(rows, axis=1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - min_len + 1
    least = np.minimum(before[:last], after[reach - 1 : reach - 1 + last])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    lens = ends - starts
    owner = np.repeat(np.arange(len(ends)), lens)
    valid = np.arange(last) + min_len <= ends[owner[:last]]
    place = np.flatnonzero(valid)
    if not len(place):
        return none, none, none
    t = at[place]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (place[1:] != place[:-1] + 1)))
    lo, hi = place[new], place[np.concatenate((new[1:], [True]))]
    return t[new], lo, hi


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def repeated(contexts: list[bytes], before: np.ndarray, width: np.ndarray, weight: np.ndarray, min_len: int, reach: int) -> np.ndarray:
    """Which strings of each context repeat. Context i holds before[i] bytes left of its trigger; its strings start
    before[i] - width[i] .. before[i] bytes left of it. weight: occurrences. Gives [a, i]: the string of context i that
    starts a bytes left of the trigger occurs twice or more."""
    k = len(contexts)
    out = np.zeros((reach, k), bool)
    right = _ranks([c[b:] for c, b in zip(contexts, before.tolist(), strict=True)], min_len)
    left = _ranks([c[:b][::-1] for c, b in zip(contexts, before.tolist(), strict=True)], reach)
    many = np.minimum(weight, 2)
    for a in range(reach):
        ix = np.flatnonzero((a <= before) & (a >= before - width))
        if not len(ix):
            continue
        pair = _classes(right, min_len - a)[ix] * np.int64(k + 1) + _classes(left, a)[ix]
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=many[ix][order])
        out[a, ix[order]] = total[group] >= 2
    return out


def _ranks(strings: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and the common prefix of each with the one before it in that order."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    table = np.zeros((len(strings), most), np.uint8)
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    rows = np.repeat(np.arange(len(strings)), lens)
    table[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    differ = table[order[1:]] != table[order[:-1]]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return order, np.concatenate(([0], np.minimum(same, np.minimum(lens[order[1:]], lens[order[:-1]]))))


def _classes(ranks: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Equal numbers for strings with the same first `length` bytes."""
    order, common = ranks
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length) if length else 0
    return out


def _united(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of byte intervals [start, end)."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return list(zip(spans[new, 0].tolist(), reach[np.concatenate((new[1:], [True]))].tolist(), strict=True))


def _texts(rows: Iterator, take: int = 1 << 18) -> Iterator[tuple[list[bytes], list[tuple]]]:
    """Unpacked texts and the other columns of rows whose first column is a compressed text, some 100 KB at a time."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    rest: list[tuple] = []
    total = 0
    for b in rows:
        cols = [c for c in b.columns]
        for i in range(b.num_rows):
            texts.append(d.decompress(cols[0][i].as_py()))
            rest.append(tuple(c[i].as_py() for c in cols[1:]))
            total += len(texts[-1])
            if total >= take:
                yield texts, rest
                texts, rest, total = [], [], 0
    if texts:
        yield texts, rest


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, z): each distinct text once, compressed, under two 64-bit hashes; partitioned by k1. Copies are merged
    before and after the shuffle."""

    def pack(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in rows:
            z = [c.compress(x) for x in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.to_bytes(8, "little", signed=True) + x for k, x in zip(b.column(1).to_pylist(), z, strict=True)], pa.binary())], ["k1", "z"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(*_keys(text), text.alias("text")).mapInArrow(frugal(pack), "k1 long, z binary")
    one = packed.groupBy("k1").agg(F.collect_set("z").alias("z"))
    return one.select("k1", F.explode("z").alias("z"))


def _keys(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")]


def _key2(z: bytes) -> int:
    return int.from_bytes(z[:8], "little", signed=True)


def _read(rows: Iterator, min_len: int, reach: int) -> Iterator[tuple]:
    """Of each few MB of (z, k1, ...): the bytes, their window hashes, the triggers' places, first and last starts and texts,
    the texts' starts, and the rows' further columns (k1, k2, ...)."""
    for texts_, rest in _texts(_unkeyed(rows)):
        buf, ends = _packed(texts_)
        windows = Windows(buf)
        t, first, last = triggers(buf, ends, min_len, reach, windows)
        yield buf, windows, t, first, last, np.searchsorted(ends, t, side="right"), np.concatenate(([0], ends[:-1])), rest


def spans(texts: DataFrame, min_len: int = MIN_LEN, reach: int | None = None, family: int = FAMILY) -> DataFrame:
    """(k1, k2, start, stop): byte intervals of the distinct texts whose strings occur twice or more among them."""
    reach = reach or max(1, min_len * 3 // 4)

    def scan(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for _, windows, t, _, _, own, base, rest in _read(rows, min_len, reach):
            f = windows.shared(t, reach, min_len)
            k1 = np.array([r[0] for r in rest], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(k1[own]), pa.array((t - base[own]).astype(np.int32))], ["f", "k1", "t"])

    def contexts(rows: Iterator) -> Iterator:
        merged: dict[tuple, list] = {}
        for buf, windows, t, first, last, own, base, rest in _read(rows, min_len, reach):
            size = [len(r[2]) for r in rest]
            o = np.repeat(np.arange(len(rest)), size)
            p = np.fromiter((x for r in rest for x in r[2]), np.int64, sum(size)) + base[o]
            i = np.searchsorted(t, p)
            whole, f = buf.tobytes(), windows.shared(p, reach, min_len).view(np.int64)
            for o_, p_, a, b, key in zip(o.tolist(), p.tolist(), first[i].tolist(), last[i].tolist(), f.tolist(), strict=True):
                context = whole[a : b + min_len]
                merged.setdefault((key, _digest(context, p_ - a), p_ - a, b - a, context), []).append((rest[o_][0], rest[o_][1], p_ - int(base[o_])))
            if len(merged) >= MERGE:
                yield _sent(merged)
                merged = {}
        if merged:
            yield _sent(merged)

    def halve(rows: Iterator) -> Iterator:
        """The contexts of the nearer and the farther half of a family's strings."""
        import pyarrow as pa

        for b in rows:
            out = []
            for _, _, lead, width, context, members, n, low, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for lo, w in ((low, part - part // 2), (low + part - part // 2, part // 2)):
                    far, near = min(lead, lo + w - 1), max(lead - width, lo)
                    if far >= near:
                        own = context[lead - far : lead - near + min_len]
                        shared = context[lead - lo : lead - lo - w + 1 + min_len]
                        f = hashlib.blake2b(b"%d %d " % (lo, w) + shared, digest_size=8).digest()
                        out.append((int.from_bytes(f, "little", signed=True), _digest(own, far), far, far - near, own, members, n, lo, w))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), b.columns, strict=True)], b.schema.names)

    def resolve(rows: Iterator) -> Iterator:
        group: list[tuple] = []
        for row in _sorted_rows(rows):
            if group and row[0] != group[-1][0] and len(group) >= ORDER:
                yield _resolved(group, min_len, reach)
                group = []
            if group and group[-1][:5] == row[:5]:  # an equal context from another task
                group[-1] = group[-1][:5] + (group[-1][5] + row[5], group[-1][6] + row[6])
                continue
            group.append(row)
        if group:
            yield _resolved(group, min_len, reach)

    def sent(items: DataFrame) -> DataFrame:
        of = items.groupBy("k1").agg(F.collect_list("t").alias("at"))
        return texts.join(of, "k1").select("z", "k1", "at").mapInArrow(frugal(contexts), CONTEXT)

    found = texts.select("z", "k1").mapInArrow(frugal(scan), "f long, k1 long, t int")
    families = cut(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f", "n", (F.col("n") > family).alias("large")))
    items = hot_join(found, families, "f").select("k1", "t", "large")
    if families.where("large").isEmpty():
        ready = sent(items)
    else:
        items = cut(items)
        ready = sent(items.where("not large"))
        rows = cut(sent(items.where("large")).select("*", F.lit(0).alias("low"), F.lit(reach).alias("part")))
        while True:
            # Of each context that occurs twice all strings repeat: its rows are families of their own. One without members
            # stands for them in the family.
            one = cut(rows.groupBy("c").agg(F.min(F.struct("f", "lead", "width", "context", "members", "low", "part")).alias("x"), F.sum("n").alias("all"), F.count("*").alias("n")))
            twice = hot_join(rows.select("c", "lead", "width", "members"), one.where("all > 1").select("c", "n"), "c")
            ready = ready.union(twice.select(F.xxhash64("c", "members").alias("f"), "c", "lead", "width", F.lit(b"").alias("context"), "members", F.lit(2).cast("long").alias("n")))
            members = F.when(F.col("all") > 1, F.lit(b"")).otherwise(F.col("x.members"))
            one = one.select("x.f", "c", "x.lead", "x.width", "x.context", members.alias("members"), F.least("all", F.lit(2).cast("long")).alias("n"), "x.low", "x.part")
            sizes = cut(one.groupBy("f").agg(F.count("*").alias("n")).select("f", "n", (F.col("n") > family).alias("large")))
            split = not sizes.where("large").isEmpty()
            marked = hot_join(one, sizes.withColumnRenamed("n", "m"), "f", "m")
            ready = ready.union(marked.where("not large").select(*ready.columns))
            if not split:
                break
            shape = CONTEXT + ", low int, part int"
            rows = cut(marked.where("large").drop("large").mapInArrow(halve, shape))
    return ready.repartition("f").sortWithinPartitions("f", "c").mapInArrow(frugal(resolve), SPAN)


CONTEXT = "f long, c binary, lead int, width int, context binary, members binary, n long"
SPAN = "k1 long, k2 long, start int, stop int"


def _digest(context: bytes, lead: int) -> bytes:
    return hashlib.blake2b(context + bytes([lead & 255]), digest_size=16).digest()


def _unkeyed(rows: Iterator) -> Iterator:
    """(text, k1, k2, ...) from (z, k1, ...), where z begins with k2."""
    import pyarrow as pa

    for b in rows:
        z = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([x[8:] for x in z], pa.binary()), b.column(1), pa.array([_key2(x) for x in z], pa.int64()), *b.columns[2:]], [str(i) for i in range(b.num_columns + 1)])


def _sent(merged: dict):
    import pyarrow as pa

    keys = list(merged)
    members = [np.array(m, np.int64).tobytes() for m in merged.values()]
    cols = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))]
    n = pa.array([len(m) for m in merged.values()], pa.int64())
    return pa.RecordBatch.from_arrays([*cols, pa.array(members, pa.binary()), n], ["f", "c", "lead", "width", "context", "members", "n"])


def _sorted_rows(rows: Iterator) -> Iterator[tuple]:
    for b in rows:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _resolved(group: list[tuple], min_len: int, reach: int):
    """Repeated intervals of whole families. Rows of equal contexts are one class; n counts their occurrences, of which only
    those that are not done yet are members."""
    import pyarrow as pa

    classes: dict[tuple, list] = {}
    for _, c, lead, width, context, members, n in group:
        classes.setdefault((c, lead, width, context), []).append((members, n))
    keys = list(classes)
    members = [np.frombuffer(b"".join(x for x, _ in m), np.int64).reshape(-1, 3) for m in classes.values()]
    weight = np.fromiter((sum(n for _, n in m) for m in classes.values()), np.int64, len(members))
    out: list[np.ndarray] = []

    def add(who: np.ndarray, far: int, near: int) -> None:
        """Strings that start `far` .. `near` bytes left of the trigger."""
        out.append(np.column_stack((who[:, 0], who[:, 1], who[:, 2] - far, who[:, 2] - near + min_len)))

    open_ = []
    for i, (_, lead, width, context) in enumerate(keys):
        if weight[i] > 1 and len(members[i]):
            add(members[i], lead, lead - width)
        if context:
            open_.append(i)
    if len(open_) > 1:
        ix = np.array(open_)
        lead, width = np.array([keys[i][1] for i in open_]), np.array([keys[i][2] for i in open_])
        hit = repeated([keys[i][3] for i in open_], lead, width, weight[ix], min_len, reach)
        hit[:, weight[ix] > 1] = False
        for j in np.flatnonzero(hit.any(axis=0)).tolist():
            a = np.flatnonzero(hit[:, j])
            for run in np.split(a, np.flatnonzero(np.diff(a) > 1) + 1):
                add(members[open_[j]], int(run[-1]), int(run[0]))
    table = _merged(np.concatenate(out)) if out else np.zeros((0, 4), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3].astype(np.int32))], ["k1", "k2", "start", "stop"])


def _merged(table: np.ndarray) -> np.ndarray:
    """Rows (k1, k2, start, stop) with those of one text united where they overlap or touch."""
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    text = np.cumsum(np.concatenate(([0], (table[1:, :2] != table[:-1, :2]).any(axis=1)))).astype(np.int64)
    shift = text * (int(table[:, 3].max()) + 1)
    reach = np.maximum.accumulate(table[:, 3] + shift)
    new = np.concatenate(([True], table[1:, 2] + shift[1:] > reach[:-1]))
    out = table[new]
    out[:, 3] = (reach - shift)[np.concatenate((new[1:], [True]))]
    return out


def _deduped(docs: DataFrame, text_col: str, min_len: int, reach: int | None, family: int, with_text: bool, carried: list[str]) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256, kept and the carried columns under the names c0, c1, ..."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    texts = cut(distinct_texts(docs, text_col)).where("k1 is not null")  # alike in both joins, so that one exchange serves them
    found = spans(texts, min_len, reach, family).groupBy("k1").agg(F.collect_list(F.struct("k2", "start", "stop")).alias("spans"))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"))

    def remove(batch: Iterator) -> Iterator:
        import pyarrow as pa

        for texts_, rest in _texts(_unkeyed(batch)):
            out = []
            for text_, (k1, k2, at) in zip(texts_, rest, strict=True):
                runs = _united(np.array([(x["start"], x["stop"]) for x in at or () if x["k2"] == k2], np.int64).reshape(-1, 2))
                kept, last = [], 0
                for a, b in runs:
                    kept.append(text_[last:a])
                    last = b
                kept = b"".join([*kept, text_[last:]])
                out.append((k1, k2, len(text_) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    cleaned = texts.join(found, "k1", "left").select("z", "k1", "spans").mapInArrow(frugal(remove), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= min_len)
    return rows.join(cleaned.join(copies, ["k1", "k2"]), ["k1", "k2"]).select(
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        *[f"c{i}" for i in range(len(carried))],
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, reach: int | None = None, family: int = FAMILY, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes as a string,
    without the rest of characters that a cut has split.

    A null text is empty; texts shorter than min_len lose nothing. Matches never cross texts. Repeated rows are other
    places, so they lose every string. Ids may be null or occur twice; further columns are left out. An empty table gives no
    rows.
    """
    out = _deduped(docs, text_col, min_len, reach, family, with_text, [id_col])
    return out.select(F.col("c0").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"][: int(with_text)])


def removed(docs: DataFrame, min_len: int = MIN_LEN, reach: int | None = None, family: int = FAMILY) -> DataFrame:
    """docs with repeated strings cut out of their texts, and n_chars, if there, set anew. Columns may have any names."""
    carried = [c for c in docs.columns if c != "text"]
    out = _deduped(docs, "text", min_len, reach, family, True, carried)
    named = {c: F.col(f"c{i}") for i, c in enumerate(carried)} | {"text": F.col("kept")}
    if "n_chars" in named:
        named["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[named[c].alias(c) for c in docs.columns])
