"""Spelling variants: words at one inserted, deleted or replaced letter from each other, and the form that a word stands for.

Two words at distance one share the first half of the shorter or its last half. So each word is dealt, under its own length
and under the length of the words it is one letter longer than, to the group of its first half and to that of its last half;
a shard holds many groups. A shard has a minimal acyclic automaton of its words and one of their mirror images, both with
perfect-hash numbers (how many words stand before a word is the sum of what its edges skip). A query matches its half
exactly, forward or backward, and completes with one error in the other half.

A pair belongs to one group only: that whose open part holds the place where the two words part, which both know from the
pair itself. So nothing has to be sorted out afterwards. A group of more than LIMIT words is dealt anew by halving the open
part: the error lies in its latter or in its former half, so the other half is shared as well. An open part of one letter
leaves at most 90 + 90 ** 2 words a group, less than LIMIT, so this ends, however many words share a beginning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Letters, least length of a word and least number of its occurrences; one run in so many loses a letter.
RUN, LEAST, SEEN, EVERY = "[A-Za-zÀ-ÿ]+", 5, 3, 97
#: Words of a group, and rows of a shard of all lengths together.
LIMIT, SHARD = 20_000, 1 << 16
_KEY = ["size", "lo", "hi", "first", "last"]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """(word): each maximal run of letters, A-Z lower-cased, less a letter if `every` divides the crc32 of `<doc_id>:<run>`:
    that at the place crc32 % length. A null text has none, a null id counts as the empty text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
    run = docs.select(own, F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(RUN), 0)).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    run = run.select("_run", h.alias("_h"), F.length("_run").alias("_n"))
    at = (F.col("_h") % F.col("_n")).cast("int")
    edited = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.col("_n")))
    return run.select(F.when(F.col("_h") % every == 0, edited).otherwise(F.col("_run")).alias("word"))


def words(docs: DataFrame, least: int = LEAST, seen: int = SEEN, **kw) -> DataFrame:
    """(word, n) of words of at least `least` letters that occur at least `seen` times."""
    return runs(docs, **kw).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def _halves(table: DataFrame, least: int) -> DataFrame:
    """A row of word and n for each group that the word is in: size of the shorter word, letters that the group shares at
    the front (lo, first) and at the end (hi, last)."""
    both = table.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where(F.col("size") >= least)
    half = F.floor(F.col("size") / 2).cast("int")
    ways = F.array(F.struct(half.alias("lo"), F.lit(0).alias("hi")), F.struct(F.lit(0).alias("lo"), (F.col("size") - half).alias("hi")))
    return _keyed(both.select("word", "n", "size", F.inline(ways)))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "size", "lo", "hi", F.col("word").substr(F.lit(1), F.col("lo")).alias("first"), F.col("word").substr(F.length("word") - F.col("hi") + 1, F.col("hi")).alias("last"))


def _halved(rows: DataFrame) -> DataFrame:
    """The rows of a group in the groups of the two halves of its open part."""
    s = F.col("size") - F.col("lo") - F.col("hi")
    front = F.floor(s / 2).cast("int")
    ways = F.array(F.struct((F.col("lo") + front).alias("lo"), F.col("hi")), F.struct(F.col("lo"), (F.col("hi") + s - front).alias("hi")))
    return _keyed(rows.select("word", "n", "size", F.inline(ways)))


def dealt(table: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """Rows of _halves, those of groups of more than `limit` words halved until none is left or one letter is open."""
    rows, done = _halves(table, least), None
    while True:
        large = cut(rows.where(F.col("size") - F.col("lo") - F.col("hi") > 1).groupBy(*_KEY).agg(F.count("*").alias("_many")).where(F.col("_many") > limit).select(*_KEY))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, _KEY, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        rows = cut(_halved(rows.join(large, _KEY, "left_semi").select(*rows.columns)))


class Automaton:
    """Minimal acyclic automaton of sorted distinct words of one length or one letter more (numbered letters, padded with
    zeros) with perfect-hash numbers.

    step[s, c] is the state after letter c, 0 for none; skip[s, c] the number of words from s before those by c; final[s].
    States are met from the longest prefixes on: prefixes with the same letters to the same states are one state. By the
    words' lengths, only prefixes of one length or of neighbouring lengths can be.
    """

    def __init__(self, letters: np.ndarray, size: np.ndarray):
        n, width = letters.shape
        a = int(letters.max(initial=0)) + 1
        lcp = np.full(n, -1)
        if n > 1:
            lcp[1:] = (np.pad(letters[1:], ((0, 0), (0, 1))) != np.pad(letters[:-1], ((0, 0), (0, 1)), constant_values=255)).argmax(axis=1)
        turns = np.random.default_rng(a).integers(1, 1 << 63, a, np.uint64) | np.uint64(1)
        step_of, final_of, count_of, states = np.zeros((1024, a), np.int32), np.zeros(1024, bool), np.zeros(1024, np.int64), 1
        known, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        below, state = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(width, -1, -1):
            here = np.flatnonzero((lcp < d) & (size >= d))
            step = np.zeros((len(here), a), np.int32)
            if len(below):
                step[np.searchsorted(here, below, side="right") - 1, letters[below, d]] = state
            final = size[here] == d
            mixed = (step.astype(np.uint64) * turns).sum(axis=1, dtype=np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + final
            new, first, which = np.unique(mixed, return_index=True, return_inverse=True)
            met, number = np.zeros(len(new), bool), np.zeros(len(new), np.int64)
            if len(known):
                old = np.minimum(np.searchsorted(known, new), len(known) - 1)
                met, number = known[old] == new, at[old]
            add = first[~met]
            number[~met] = np.arange(states, states + len(add))
            while states + len(add) > len(final_of):
                step_of, final_of, count_of = (np.concatenate([x, np.zeros_like(x)]) for x in (step_of, final_of, count_of))
            step_of[states : states + len(add)], final_of[states : states + len(add)] = step[add], final[add]
            count_of[states : states + len(add)] = count_of[step[add]].sum(axis=1) + final[add]
            states += len(add)
            state, below, known, at = number[which], here, new, number
            if (step_of[state] != step).any() or (final_of[state] != final).any():
                raise ArithmeticError("two states with one hash")
        self.step, self.final, self.count = step_of[:states], final_of[:states], count_of[:states]
        self.start = int(state[0]) if n else 0
        upto = np.cumsum(self.count[self.step], axis=1)
        self.skip = upto - self.count[self.step] + self.final[:, None]

    def near(self, query: np.ndarray, exact: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of query, number) of the words that are one replaced or one inserted letter from a query, a word of the
        automaton itself: the first `exact` letters match, and the two part before the place `stop` at the latest."""
        n, size = query.shape
        path, number = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
        path[:, 0] = self.start
        for p in range(size):
            s, c = path[:, p], query[:, p]
            path[:, p + 1], number[:, p + 1] = self.step[s, c], number[:, p] + self.skip[s, c]
        q, p = np.nonzero((np.arange(size + 1) >= exact[:, None]) & (np.arange(size + 1) <= stop[:, None]))
        own = np.where(p < size, query[q, np.minimum(p, size - 1)], 0)
        open_ = self.step[path[q, p]] > 0
        open_[np.arange(len(q)), own] = False
        k, c = np.nonzero(open_)
        q, p = q[k], p[k]
        s = path[q, p]
        state, count = self.step[s, c], number[q, p] + self.skip[s, c]
        swap = p < size
        q, p, state, count = np.concatenate([q[swap], q]), np.concatenate([p[swap] + 1, p]), np.concatenate([state[swap], state]), np.concatenate([count[swap], count])
        found: list[tuple] = []
        while len(q):
            end = p == size
            hit = end & self.final[state]
            found.append((q[hit], count[hit]))
            q, p, state, count = q[~end], p[~end], state[~end], count[~end]
            c = query[q, p]
            after = self.step[state, c]
            live = after > 0
            count = (count + self.skip[state, c])[live]
            q, p, state = q[live], p[live] + 1, after[live]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def near_in_shard(own: list[str], n: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Of the words of a shard, of `size` letters or one more: (word, near words found here, n of the most frequent of them,
    and that word, the least of equals). lo and hi are the shared ends of the word's group."""
    width = size + 1
    packed = np.array([w.encode("latin-1") for w in own], f"S{width}")
    table, first, where = np.unique(packed, return_index=True, return_inverse=True)
    n = n[first]
    raw = table.view(np.uint8).reshape(len(table), width)
    code = np.zeros(256, np.uint8)
    used = np.unique(raw[raw > 0])
    code[used] = np.arange(1, len(used) + 1)
    letters, sizes = code[raw], (raw > 0).sum(axis=1)
    pairs: list[tuple] = []
    query = sizes[where] == size
    block = max(1, (1 << 22) // (width * (len(used) + 1)))
    ahead = query & ((lo > 0) | (hi == 0))
    if ahead.any():
        automaton = Automaton(letters, sizes)
        at = np.flatnonzero(ahead)
        for part in np.split(at, range(block, len(at), block)):
            rows = where[part]
            q, v = automaton.near(letters[rows, :size], lo[part], np.where(hi[part] > 0, size - hi[part] - 1, size))
            pairs.append((rows[q], v))
    back = query & (lo == 0) & (hi > 0)
    if back.any():
        turned = np.where(np.arange(width) < sizes[:, None], np.take_along_axis(letters, np.maximum(sizes[:, None] - 1 - np.arange(width), 0), axis=1), 0).astype(np.uint8)
        order = np.lexsort(turned.T[::-1])
        turned, inverse = turned[order], np.argsort(order)
        automaton = Automaton(turned, sizes[order])
        at = np.flatnonzero(back)
        for part in np.split(at, range(block, len(at), block)):
            rows = where[part]
            q, v = automaton.near(turned[inverse[rows], :size], hi[part], np.full(len(part), size))
            u, v = rows[q], order[v]
            apart = (np.pad(letters[u, :size], ((0, 0), (0, 1)), constant_values=255) != letters[v]).argmax(axis=1)
            mine = apart < size - hi[part][q]
            pairs.append((u[mine], v[mine]))
    if not pairs:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    once = (u < v) | (sizes[u] != sizes[v])  # words of one length find each other
    u, v = np.concatenate([u[once], v[once]]), np.concatenate([v[once], u[once]])
    order = np.lexsort((v, -n[v], u))
    u, v = u[order], v[order]
    head = np.flatnonzero(np.diff(u, prepend=-1))
    text = [x.decode("latin-1") for x in table.tolist()]
    return [text[i] for i in u[head].tolist()], np.diff(np.append(head, len(u))), n[v[head]], [text[i] for i in v[head].tolist()]


def near(table: DataFrame, least: int = LEAST, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) for words of table (word, n) with near words, a row for each shard that found some."""
    rows = dealt(table, least, limit)
    parts = 1 + 4 * table.count() // shard
    rows = rows.select("size", F.pmod(F.xxhash64(*_KEY), F.lit(parts)).alias("shard"), "word", "n", "lo", "hi")

    def run(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        number = lambda c: t.column(c).to_numpy()
        got = near_in_shard(t.column("word").to_pylist(), number("n"), number("lo"), number("hi"), key[0].as_py())
        return pa.Table.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64()), pa.array(got[3], pa.string())], ["word", "n_near", "best_n", "best"])

    return rows.groupBy("size", "shard").applyInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows without a null: the last form reached. A form is at least twice as frequent as its
    word, so paths end; each round doubles the steps, so that rounds grow with the logarithm of their length."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        moved = cut(reached.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")))
        reached = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return reached


def variants(docs: DataFrame, least: int = LEAST, seen: int = SEEN, limit: int = LIMIT, shard: int = SHARD, **kw) -> DataFrame:
    """Per word of docs: word, form, root, n, n_near, form_n.

    form is the near word of largest n, the least of equals in code-point order, if it is at least twice as frequent as the
    word, else null; root is what forms lead to, the word itself without one. Null and empty texts have no words, repeated
    rows count each, bytes that aren't UTF-8 part runs; an empty table gives no rows; other columns don't matter.
    """
    table = cut(words(docs, least, seen, **kw))
    found = near(table, least, limit, shard)
    met = table.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")).unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))
    met = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("_best"))
    fits = -F.col("_best.less") >= 2 * F.col("n")
    met = cut(met.select("word", "n", "n_near", F.when(fits, F.col("_best.best")).alias("form"), F.when(fits, -F.col("_best.less")).alias("form_n")))
    ends = roots(met.where("form is not null").select("word", "form"))
    return met.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
