"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a SentencePiece model (B) end together.

Python only tokenises: each text becomes two arrays of ids and two arrays of byte ends. All that follows is Spark's own
functions. array_intersect of the end arrays gives the common ends, a group each; transform makes marks of them, which the sorted
array of a side's tokens and marks has after each group's last token, so that groups are cut in linear time; zip_with puts
both sides' groups and last tokens together. A link is the last token of A and the last of B in a group.

Two linked tokens end at one byte, so the bytes of one are a suffix of the other's. That bounds the table of id pairs by
the two vocabularies alone (`most_pairs`), whatever the corpus is, and it is broadcast under that bound.

Texts are cut into units before each space that follows a character that isn't white space: no pre-token of A and no piece
of B reaches across, which is checked for B's vocabulary. Distinct units are tokenised once for as long as a worker keeps
them, whole texts are put together from them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, shared_dir
from .pieces import MARK, Bpe, _model, load

#: Units that a tokenising worker keeps before it starts anew, and bytes of texts put together at once.
KEPT, PART = 200_000, 2 << 20
#: A token is its end times 2**END and its id, less than MARK_ID; a link is a's id times 2**SHIFT and b's id.
END, SHIFT = 26, 26
MARK_ID = (1 << END) - 1
#: Fixed value: how a byte-level vocabulary's texts are cut before its merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE, _HEAD = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def byte_level() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: the printable ones of Latin-1 stand for themselves,
    the others take the code points from 256 in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def bytes_of_a(data: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file; special tokens are not byte-level and stand for nothing."""
    own, table = json.loads(data)["model"]["vocab"], byte_level()
    out = [b""] * (1 + max(own.values()))
    for token, i in own.items():
        if all(c in table for c in token):
            out[i] = bytes(table[c] for c in token)
    return out


def bytes_of_b(data: bytes) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    sp = _model(data)
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together at most: those of which one's bytes are a suffix of the other's."""
    many: list[dict[bytes, int]] = [{}, {}]
    for side, tokens in enumerate((a, b)):
        for t in tokens:
            many[side][t] = many[side].get(t, 0) + 1
    longer = sum(n * many[1].get(t[i:], 0) for t, n in many[0].items() for i in range(len(t)))
    return longer + sum(n * many[0].get(t[i:], 0) for t, n in many[1].items() for i in range(1, len(t)))


class _Side:
    """Ids and byte lengths of numbered units."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.size = raw, np.array([len(t) for t in raw], np.int32)
        self.ids, self.first, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def add(self, numbers: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Units with these numbers have n ids each, which follow each other in ids."""
        more = int(numbers.max(initial=-1)) + 1 - len(self.n)
        if more > 0:
            self.first, self.n = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.first, self.n))
        self.first[numbers] = len(self.ids) + np.cumsum(n) - n
        self.n[numbers] = n
        self.ids = np.concatenate([self.ids, ids])

    def joined(self, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, offsets) of texts whose units are codes[cuts[i]:cuts[i + 1]]."""
        n = self.n[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[codes] - upto[:-1], n) + np.arange(upto[-1])]
        offsets = upto[cuts]
        ends = np.concatenate([[0], np.cumsum(self.size[ids], dtype=np.int64)])
        return ids, (ends[1:] - np.repeat(ends[offsets[:-1]], np.diff(offsets))).astype(np.int32), offsets.astype(np.int32)


class Tokenizers(dict):
    """Both tokenizers over the distinct units that were met: unit without its leading space -> number."""

    def __init__(self, a: bytes, b: bytes):
        import tiktoken

        super().__init__()
        self.raw = bytes_of_a(a), bytes_of_b(b)
        merges = [m.split(" ") if isinstance(m, str) else m for m in json.loads(a)["model"]["merges"]]
        rank = {t: i for i, t in enumerate(self.raw[0]) if t}
        own = byte_level()
        if any(rank[bytes(own[c] for c in left + right)] != len(own) + i for i, (left, right) in enumerate(merges)):
            raise ValueError("the ids of the byte-level vocabulary don't follow its merges")
        self.encoder = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=rank, special_tokens={})
        self.pieces = Bpe(b)
        self.whole = any(re.search(f"[^{MARK}]{MARK}", _model(b).id_to_piece(i)) for i in range(len(self.raw[1])))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.sides, self.exact = (_Side(self.raw[0]), _Side(self.raw[1])), np.zeros(0, bool)

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = len(self)
        return len(self) - 1

    def cut(self, text: str) -> list[str]:
        """The units of a space and a text, each without its leading space."""
        if self.whole:
            return [text]
        if text[0] != " " and text[-1] != " " and not _UNSAFE.search(text):
            return text.split(" ")
        parts = _HEAD.split(" " + text)
        if len(parts) > 1 and not parts[-1].strip(" "):
            parts[-2:] = [parts[-2] + parts[-1]]
        return [p[1:] for p in parts]

    def _encoded(self, texts: list[str]) -> list[list[np.ndarray]]:
        a = [self.encoder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]
        return [a, self.pieces.encode_all(texts, [""] * len(texts))]

    def tokenise(self) -> None:
        """Ids of the new units, and whether both sides give back their bytes. Units stand in one text, but those that end in
        white space, which what follows could join, and those with the space mark, which B doesn't tell from a space; if that text isn't given back, each unit is seen by itself."""
        new = self.new
        if not new:
            return
        base = len(self) - len(new)
        alone = np.array([self.whole or u[-1:].isspace() or not u or MARK in u for u in new])
        self.exact = np.concatenate([self.exact, np.ones(len(new), bool)])
        joint = [u for u, x in zip(new, alone, strict=True) if not x]
        if joint:
            text = " ".join(joint)
            own = (" " + text).encode()
            spaces = np.flatnonzero(np.frombuffer(own, np.uint8) == 32) if own.count(b" ") == len(joint) else None
            ends = np.append(spaces[1:], len(own)) if spaces is not None else np.cumsum([len(u.encode()) + 1 for u in joint])
            found = [ids for (ids,) in self._encoded([text])]
            upto = [np.cumsum(side.size[ids]) for side, ids in zip(self.sides, found, strict=True)]
            cuts = [np.searchsorted(x, ends) + 1 for x in upto]
            if all(side.bytes(ids) == own and (x[c - 1] == ends).all() for side, ids, x, c in zip(self.sides, found, upto, cuts, strict=True)):
                for side, ids, c in zip(self.sides, found, cuts, strict=True):
                    side.add(base + np.flatnonzero(~alone), ids, np.diff(c, prepend=0))
            else:
                alone[:] = True
        at = np.flatnonzero(alone)
        if len(at):
            few = [new[i] for i in at.tolist()]
            for side, lists in zip(self.sides, self._encoded(few), strict=True):
                side.add(base + at, np.concatenate(lists), np.array([len(x) for x in lists]))
                self.exact[base + at] &= [side.bytes(ids) == b" " + u.encode() and MARK not in u for u, ids in zip(few, lists, strict=True)]
        self.new = []

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B (ids, ends, offsets) of the texts. A text that one side doesn't give back has no tokens."""
        if len(self) > KEPT:
            self.reset()
        units = [self.cut(t) if t else [] for t in texts]
        codes = np.array([c for own in units for c in map(self.__getitem__, own)], np.int64)
        self.tokenise()
        size = np.array([len(own) for own in units])
        wrong = np.concatenate([[0], np.cumsum(~self.exact[codes])])
        cuts = np.concatenate([[0], np.cumsum(size)])
        kept = wrong[cuts[1:]] == wrong[cuts[:-1]]
        if not kept.all():
            codes = codes[np.repeat(kept, size)]
            cuts = np.concatenate([[0], np.cumsum(np.where(kept, size, 0))])
        return [side.joined(codes, cuts) for side in self.sides]


@lru_cache(maxsize=1)
def _tokenizers(a: bytes, b: bytes) -> Tokenizers:
    return Tokenizers(a, b)


def _decoded(text: bytes | None) -> str:
    try:
        return (text or b"").decode()
    except UnicodeDecodeError:
        return ""


def tokenised(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, a_ends, b, b_ends) for each row of docs: the byte of space and text that each token ends before, and tokens
    as that end times 2**END and the id."""
    held = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        both = _tokenizers(*held.value)
        kinds = [pa.list_(pa.field("element", k, False)) for k in (pa.int64(), pa.int32())]
        for own, texts in batches(rows, PART):
            lists = []
            for ids, ends, offsets in both([_decoded(t) for t in texts]):
                tokens = (ends.astype(np.int64) << END) + ids
                lists += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), type=k) for x, k in zip((tokens, ends), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *lists], ["doc_id", "a", "a_ends", "b", "b_ends"])

    kinds = {"a": T.LongType(), "a_ends": T.IntegerType(), "b": T.LongType(), "b_ends": T.IntegerType()}
    shape = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.ArrayType(k, False), False) for c, k in kinds.items()])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, shape)


def grouped(tokens: DataFrame) -> DataFrame:
    """Adds to tokens: groups array<string> (`a1,a2|b1`) and links array<long>, one of each for each common end."""
    marks = F.transform("_common", lambda e: F.shiftleft(e.cast("long"), END).bitwiseOR(F.lit(MARK_ID)))
    met = tokens.withColumn("_common", F.array_intersect("a_ends", "b_ends")).withColumn("_marks", marks)
    met = met.withColumns({f"_{c}": F.sort_array(F.concat(c, "_marks")) for c in "ab"})
    met = met.withColumns({f"_{c}": F.array_join(F.transform(f"_{c}", lambda t: t.bitwiseAND(MARK_ID)).cast("array<string>"), ",") for c in "ab"})
    # Each group's ids, then `;`: the mark after a group's last token takes the place of a comma.
    met = met.withColumns({f"_{c}": F.replace(F.replace(f"_{c}", F.lit(f",{MARK_ID}"), F.lit(";")), F.lit(";,"), F.lit(";")) for c in "ab"})
    each = {c: F.split(F.rtrim(f"_{c}", F.lit(";")), ";") for c in "ab"}
    last = {c: F.regexp_extract_all(f"_{c}", F.lit("([0-9]+);"), 1).cast("array<long>") for c in "ab"}
    groups = F.zip_with(each["a"], each["b"], lambda a, b: F.concat(a, F.lit("|"), b))
    links = F.zip_with(last["a"], last["b"], lambda a, b: F.shiftleft(a, SHIFT).bitwiseOR(b))
    none = F.array().cast("array<string>")
    return met.select(*tokens.columns, F.when(F.size("_common") > 0, groups).otherwise(none).alias("groups"), links.alias("links"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is linked most often in the corpus among all pairs of its B id, count_sum adds up how
    often the pairs are linked in the corpus. A text that is null, empty, not UTF-8 or not given back by both tokenizers has
    no tokens: zeros, and groups_sha256 is empty. Repeated rows count each; an empty table gives no rows; other columns don't
    matter. Texts are tokenised once: the links are written to the shared folder and read for the counts and for the sums.
    """
    a, b = load(a_path), load(b_path)
    spark = docs.sparkSession
    bound = most_pairs(bytes_of_a(a), bytes_of_b(b))
    at = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    found = grouped(tokenised(docs, a, b, id_col, text_col))
    sha = F.when(F.size("groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("").alias("groups_sha256")
    size = lambda c, n: F.size(c).cast("long").alias(n)
    found = found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", size("a", "n_a"), size("b", "n_b"), size("groups", "n_groups"), size("links", "n_links"), sha, "links")
    found.write.option("compression", "zstd").parquet(at)
    found = spark.read.parquet(at)
    counts = found.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = counts.withColumn("most", F.max("n").over(_by_b())).select("link", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if bound < 1 << 22:
        counts = F.broadcast(counts)
    sums = found.select("_row", F.explode("links").alias("link")).join(counts, "link").groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    kept = found.drop("links").join(sums, "_row", "left")
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def _by_b():
    from pyspark.sql import Window as W

    return W.partitionBy(F.col("link").bitwiseAND((1 << SHIFT) - 1))
