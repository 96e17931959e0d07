"""SentencePiece vocabularies: BPE encoding with seeded merge-dropout, lossless decoding, and count-only Viterbi.

BPE. A text is cut where no merge can reach: between characters that no piece has side by side. In a unit, symbols start
as characters, and an agenda holds the merges of neighbours that are pieces, best score first, then leftmost. Agendas of
many units are worked off together: a round takes the best candidate of each. With dropout a candidate, as it is taken,
is skipped for good if a keyed hash of seed, text, document, pass and the candidate's own place in the text (start, middle
and end) falls below the rate, so each candidate of each place has a draw of its own and nothing is kept between units.
Characters without a piece become bytes, and so does the literal space mark, which makes decoding exact.

Counts. Words are units that begin with the space mark. An Aho-Corasick automaton gives the vocabulary's matches by their
end, longest first; dynamic programming keeps, for each end, the best score and its number of pieces. A later match
replaces an earlier only if it is strictly better, as the tokenizer does; a character without a piece costs the least
score less 10 and counts one piece for each of its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, frugal

RATE, SEED = 0.1, 2
MARK = "\u2581"
_HEAD = re.compile("(?<=[^ ])(?= )")
#: Characters handled at once, and widths of the tables that units of up to so many characters are worked off in.
PART, WIDTHS = 1 << 19, (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64)
#: The rank of no candidate.
NEVER = np.iinfo(np.int32).max
_TURNS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Units that a counting worker keeps.
KEPT = 1_000_000


def load(path: str) -> bytes:
    """The model file, read on the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _model(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


class Pairs:
    """Which pairs of symbols make a symbol: an open-addressed table of numpy arrays, looked up many pairs at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, to: np.ndarray):
        bits = max(8, (8 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NEVER, np.int32)
        self.to = np.zeros(1 << bits, np.int32)
        keys, todo = self._keys(left, right), np.arange(len(left))
        home, self.probes = self._home(keys), 0
        while len(todo):
            at = (home[todo] + self.probes) & self.mask
            free = np.flatnonzero(self.key[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            own = todo[free]
            self.key[at[free]], self.rank[at[free]], self.to[at[free]] = keys[own], rank[own], to[own]
            todo = np.delete(todo, free)
            self.probes += 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64)
        return (((h ^ (h >> np.uint64(19))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of each pair; rank NEVER where it makes none."""
        keys = self._keys(left, right)
        home = self._home(keys)
        at = home.copy()
        found = self.key[at]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(todo):
                break
            at[todo] = (home[todo] + probe) & self.mask
            found = self.key[at[todo]]
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return np.where(self.key[at] == keys, self.rank[at], NEVER), self.to[at]


class Bpe:
    """Encoder and decoder of a BPE model. rate 0: the model's own segmentation.

    Symbols are numbers: piece ids, then characters that occur in pieces without being one, then one for all others.
    """

    def __init__(self, data: bytes, rate: float = 0.0, seed: int = SEED):
        sp = _model(data)
        self.rate, self.seed = rate, seed
        self.order: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                own = piece.replace(MARK, " ")
                self.order[own], self.id[own] = -sp.get_score(i), i
                self.raw.append(own.encode())
        ranks = {score: i for i, score in enumerate(sorted(set(self.order.values())))}
        self.rank = {p: ranks[score] for p, score in self.order.items()}
        chars = sorted({c for p in self.id for c in p})
        symbol = dict(self.id)
        for c in chars:
            symbol.setdefault(c, len(self.raw) + len(symbol) - len(self.id))
        self.other = len(self.raw) + len(symbol) - len(self.id)
        self.symbol = np.full(0x110000, self.other, np.int32)
        self.kind = np.zeros(0x110000, np.uint16)
        points = np.array([ord(c) for c in chars])
        self.symbol[points] = [symbol[c] for c in chars]
        self.kind[points] = np.arange(1, len(chars) + 1)
        # Neighbours that some piece has: elsewhere no merge can reach, and texts are cut into units.
        near = np.array([(ord(a), ord(b)) for p in self.id for a, b in zip(p, p[1:], strict=False)])
        self.near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.near[self.kind[near[:, 0]], self.kind[near[:, 1]]] = True
        made = [(symbol[p[:i]], symbol[p[i:]], self.rank[p], own) for p, own in self.id.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        self.pairs = Pairs(*np.array(made, np.int64).T)

    def skipped(self, key: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether the candidate that merges [start, middle) with [middle, stop) is skipped in the text of this key."""
        h = _mixed(key + start.astype(np.uint64) * _TURNS[0] + middle.astype(np.uint64) * _TURNS[1] + stop.astype(np.uint64) * _TURNS[2])
        return (h >> np.uint64(11)).astype(np.float64) < self.rate * (1 << 53)

    def _merged(self, sym: np.ndarray, key: np.ndarray, start: np.ndarray) -> None:
        """Work off the agendas of many units at once. Row i of sym holds a unit's symbols, and `other` from its end on, its
        last column included; key and start are of the unit's text and of its place there. A round takes the best candidate
        of each unit, leftmost of equals. A merged symbol stands at its start, with -1 at its further characters."""
        n, width = sym.shape
        own = sym.ravel()
        flat, new = self.pairs(own, np.append(own[1:], self.other))
        rank = flat.reshape(n, width)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1)).ravel()
        rows = np.arange(n)
        while len(rows):
            part = rank[rows]
            j = part.argmin(axis=1)
            live = part[np.arange(len(rows)), j] != NEVER
            rows, j = rows[live], j[live]
            base = rows * width
            at = base + j
            k = after[at]
            stop = after[base + k]
            some = slice(None)
            if self.rate:
                gone = self.skipped(key[rows], start[rows] + j, start[rows] + k, start[rows] + stop)
                flat[at[gone]] = NEVER
                some = ~gone
            base, at, j, k, stop = base[some], at[some], j[some], k[some], stop[some]
            own[at] = new[at]
            own[base + k] = -1
            flat[base + k] = NEVER
            after[at] = stop
            before[base + stop] = j
            flat[at], new[at] = self.pairs(own[at], own[base + stop])
            left = before[at]
            has = left >= 0
            base, at = base[has] + left[has], at[has]
            flat[base], new[base] = self.pairs(own[base], own[at])

    def _long(self, points: np.ndarray, sym: np.ndarray, key: np.uint64, start: int) -> None:
        """The same for one unit too long for a row, by a heap."""
        unit, n, rank = "".join(map(chr, points.tolist())), len(points), self.rank
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in rank]
        heapq.heapify(agenda)
        key, limit, (a, b, c) = int(key), self.rate * (1 << 53), (int(x) for x in _TURNS)

        def add(i: int, j: int, stop: int) -> None:
            s = unit[i:stop]
            if s in rank:
                heapq.heappush(agenda, (rank[s], i, j, stop))

        while agenda:
            _, i, j, stop = heapq.heappop(agenda)
            if end[i] != j or end[j] != stop:
                continue
            if limit and _mixed_int(key + (start + i) * a + (start + j) * b + (start + stop) * c) >> 11 < limit:
                continue
            end[i], end[j], after[i] = stop, -1, stop
            if stop < n:
                before[stop] = i
                add(i, stop, end[stop])
            if before[i] >= 0:
                add(before[i], i, stop)
        sym[:] = -1
        i = 0
        while i < n:
            s = unit[i : end[i]]
            sym[i] = self.id[s] if end[i] > i + 1 else self.symbol[points[i]]
            i = end[i]

    def encode_all(self, texts: list[str], places: list[str]) -> list[np.ndarray]:
        """Ids of each text; none for the empty text. Which merges are skipped belongs to the seed, the text and its place (a
        document and a pass, say). Texts are handled a few MB at a time, a longer text in parts cut before spaces."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple] = []
        total = 0
        for i, (text, place) in enumerate(zip(texts, places, strict=True)):
            if not text:
                continue
            key = _xxh(place, _xxh(text.encode("utf-8", "surrogatepass"), self.seed)) if self.rate else 0
            for start, part in _parts(" " + text):
                held.append((i, part, key, start))
                total += len(part)
                if total >= PART:
                    self._solve(held, out)
                    held, total = [], 0
        self._solve(held, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _solve(self, held: list[tuple], out: list[list[np.ndarray]]) -> None:
        if not held:
            return
        points = np.frombuffer("".join(h[1] for h in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(h[1]) for h in held])
        first = np.cumsum(sizes) - sizes
        sym = self.symbol[points]
        kinds = self.kind[points]
        cut = np.concatenate(([True], ~self.near[kinds[:-1], kinds[1:]]))
        cut[first] = True
        units = np.flatnonzero(cut)
        lens = np.diff(np.append(units, len(points)))
        units, lens = units[lens > 1], lens[lens > 1]
        text = np.searchsorted(first, units, side="right") - 1
        keys = np.array([h[2] for h in held], np.uint64)[text]
        starts = units - first[text] + np.array([h[3] for h in held])[text]
        low = 1
        for high in WIDTHS:
            here = np.flatnonzero((lens > low) & (lens <= high))
            for ix in np.array_split(here, -(-len(here) * high // PART)) if len(here) else ():
                at = units[ix][:, None] + np.arange(high + 1)
                inside = np.arange(high + 1) < lens[ix][:, None]
                rows = np.where(inside, sym[np.minimum(at, len(sym) - 1)], self.other)
                self._merged(rows, keys[ix], starts[ix])
                sym[at[inside]] = rows[inside]
            low = high
        for u in np.flatnonzero(lens > low).tolist():
            here = slice(units[u], units[u] + lens[u])
            self._long(points[here], sym[here], keys[u], int(starts[u]))
        keep = sym >= 0
        ids, counts = sym[keep], np.add.reduceat(keep, first)
        bad = np.flatnonzero(ids >= len(self.raw))
        if len(bad):  # characters without a piece become bytes
            lost = points[keep][bad]
            spelled = {c: self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(lost).tolist()}
            reps = np.ones(len(ids), np.int64)
            reps[bad] = [len(spelled[c]) for c in lost.tolist()]
            stops = np.cumsum(reps)
            counts = np.diff(stops[np.cumsum(counts) - 1], prepend=0)
            ids = np.repeat(ids, reps)
            ids[np.repeat(reps > 1, reps)] = 0
            ids[np.concatenate([np.arange(stops[b] - reps[b], stops[b]) for b in bad])] = np.concatenate([spelled[c] for c in lost.tolist()])
        for h, own in zip(held, np.split(ids.astype("<i4"), np.cumsum(counts)[:-1]), strict=True):
            out[h[0]].append(own)

    def encode(self, text: str, place: str = "") -> bytes:
        """Ids of one text as packed little-endian 32-bit integers."""
        return self.encode_all([text], [place])[0].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text that encode() was given, whatever merges were skipped."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:].decode("utf-8", "surrogatepass")


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(start, part) of a text; all but the last are about PART characters long and end before a space that follows none."""
    at = 0
    while len(text) - at > PART and (m := _HEAD.search(text, at + PART)):
        yield at, text[at : m.start()]
        at = m.start()
    yield at, text[at:]


def _xxh(data: bytes | str, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed_int(x: int) -> int:
    return int(_mixed(np.array([x & (1 << 64) - 1], np.uint64))[0])


@lru_cache(maxsize=2)
def _bpe(data: bytes, rate: float, seed: int) -> Bpe:
    return Bpe(data, rate, seed)


def encoded(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_pieces, ids_sha256 (of packed little-endian 32-bit ids), text_sha256 (of the text decoded
    from the ids) and lossless (that text is the input); with_ids adds ids.

    A null or empty text has no pieces; bytes that aren't UTF-8 are encoded as U+FFFD, and the text isn't lossless then. An
    empty table gives no rows; other columns don't matter. Draws of skipped merges belong to seed, text, doc_id and pass; rows of one doc_id and
    text that follow each other in a task, as the mix writes them, are passes. Works without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _bpe(held.value, rate, seed)
        last, turn = None, 0
        for own, texts in batches(rows, 1 << 20):
            decoded, places, out = [(t or b"").decode("utf-8", "replace") for t in texts], [], []
            for i, text in zip(own, decoded, strict=True):
                turn = turn + 1 if (i, text) == last else 0
                last = (i, text)
                places.append(f"{i} {turn}")
            for text, ids in zip(texts, bpe.encode_all(decoded, places), strict=True):
                packed = ids.tobytes()
                back = bpe.decode(packed)
                out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back.encode() == (text or b""), ids if with_ids else None))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            arrays = [pa.array(own, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "lossless", "ids"][: len(arrays)])

    shape = "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), shape)


# --- count-only Viterbi --------------------------------------------------------------------------------------------


def unigram(data: bytes) -> list[tuple[str, float]]:
    """A unigram vocabulary of a model's pieces, in their order: piece i scores -ln(i + 1)."""
    sp = _model(data)
    return [(sp.id_to_piece(i), -math.log(i + 1)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """unit -> (pieces, score) of a unigram vocabulary; keeps KEPT units at most."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10

    def __missing__(self, unit: str) -> tuple[int, float]:
        out = self.solve(unit)
        if len(unit) < 64:
            if len(self) >= KEPT:
                self.clear()
            self[unit] = out
        return out

    def solve(self, unit: str) -> tuple[int, float]:
        n, unknown = len(unit), self.unknown
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done = 0
        single = False
        for last, (size, score) in self.automaton.iter(unit):
            end = last + 1
            while done < end:  # places that no longer get matches, and the first match of this one
                if done and not single:
                    self._unknown(unit, done, best, pieces, unknown, seen)
                done, single, seen = done + 1, False, False
            value = best[end - size] + score
            if not seen or value > best[end]:
                best[end], pieces[end], seen = value, pieces[end - size] + 1, True
            single = single or size == 1
        while done <= n:
            if done and not single:
                self._unknown(unit, done, best, pieces, unknown, seen)
            done, single, seen = done + 1, False, False
        return pieces[n], best[n]

    @staticmethod
    def _unknown(unit: str, end: int, best: list, pieces: list, unknown: float, seen: bool) -> None:
        value = best[end - 1] + unknown
        if not seen or value > best[end]:
            best[end], pieces[end] = value, pieces[end - 1] + len(unit[end - 1].encode("utf-8", "surrogatepass"))

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text, cut into units before each space."""
        if not text:
            return 0, 0.0
        parts = text.replace(MARK, " ").split(" ")
        if not parts[0]:
            del parts[0]
        found = [self[MARK + p] for p in parts]
        return sum(c for c, _ in found), math.fsum(s for _, s in found)


@lru_cache(maxsize=2)
def _counter(data: bytes) -> Counter:
    return Counter(unigram(data))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, n_tokens, score (rounded to 6 places). A null or empty text has none; bytes that aren't
    UTF-8 count as U+FFFD. Repeated rows count alike, texts of any length are counted whole, an empty table gives no rows,
    other columns don't matter. Row by row, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(held.value)
        for own, texts in batches(rows, 4 << 20):
            decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
            out = list(map(counter.count, decoded))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(map(len, decoded), pa.int64()), pa.array([c for c, _ in out], pa.int64()), pa.array([round(s, 6) for _, s in out])], ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
