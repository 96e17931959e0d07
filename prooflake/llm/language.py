"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are read in windows of WINDOW bytes. In each, one layer of gated units reads forward, one backward; both
states at a byte give that byte's log-odds of the languages, so that every position has a label of its own. A document's
probabilities are the means of its positions' probabilities.

    z, r = sigmoid(E[byte] + h U)          c = tanh(E'[byte] + (r * h) U')          h <- h + z * (c - h)

Spark draws the training windows: of each language SAMPLE windows at places of a keyed hash, one of each document drawn, or
up to TAKES of each where a language has few documents. numpy fits the weights by backpropagation through time (Adam); scoring reads every byte of every
text, thousands of windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

#: Bytes of a window, units of each direction, languages at most, training windows of each language and of a document, and
#: batches of windows to learn from.
WINDOW, UNITS, LANGUAGES, SAMPLE, TAKES, STEPS, SEED = 64, 12, 64, 512, 16, 120, 13
#: Windows scored at once.
BLOCK = 4096
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights of both directions (axis 0: forward, backward) and of the output. Arrays are float32."""

    NAMES = ("embed", "gates", "cand", "out", "bias")

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        r = np.random.default_rng(seed)
        k, n = len(languages), units
        self.languages, self.units = languages, n
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.embed = draw(2, 256, 3 * n, scale=0.3)
        self.embed[:, :, :n] -= 1.0  # states change slowly at first
        self.gates, self.cand = draw(2, n, 2 * n, scale=n**-0.5), draw(2, n, n, scale=n**-0.5)
        self.out, self.bias = draw(2, n, k, scale=n**-0.5), np.zeros(k, np.float32)

    def _both(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(2, time, windows): each window's bytes as they are and turned; places after its end hold zero bytes."""
        t = np.arange(windows.shape[1])
        back = np.take_along_axis(windows, np.maximum(sizes[:, None] - 1 - t, 0), axis=1)
        return np.stack([windows.T, np.where(t < sizes[:, None], back, 0).T])

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (2, time, windows, units) after each byte of x (2, time, windows)."""
        n, (_, steps, many) = self.units, x.shape
        h = np.zeros((2, many, n), np.float32)
        out = np.empty((2, steps, many, n), np.float32)
        if trace is None:
            at = x.astype(np.intp)
            at[1] += 256
            embed = self.embed.reshape(512, 3 * n)
            e, zr, c, rh = np.empty((2, many, 3 * n), np.float32), np.empty((2, many, 2 * n), np.float32), np.empty_like(h), np.empty_like(h)
            for t in range(steps):
                np.take(embed, at[:, t], axis=0, out=e, mode="clip")
                np.matmul(h, self.gates, out=zr)
                zr += e[:, :, : 2 * n]
                _sigmoid(zr)
                np.multiply(zr[:, :, n:], h, out=rh)
                np.matmul(rh, self.cand, out=c)
                c += e[:, :, 2 * n :]
                np.tanh(c, out=c)
                c -= h
                c *= zr[:, :, :n]
                h += c
                out[:, t] = h
            return out
        for t in range(steps):
            e = np.stack([self.embed[0][x[0, t]], self.embed[1][x[1, t]]])
            zr = _sigmoid(e[:, :, : 2 * n] + h @ self.gates)
            z, r = zr[:, :, :n], zr[:, :, n:]
            c = np.tanh(e[:, :, 2 * n :] + (r * h) @ self.cand)
            trace.append((h, z, r, c))
            h = h + z * (c - h)
            out[:, t] = h
        return out

    def positions(self, windows: np.ndarray, sizes: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, ...]:
        """Probabilities (time, windows, languages) of each position, the states and the bytes read; positions after a
        window's end mean nothing."""
        x = self._both(windows, sizes)
        h = self.states(x, trace)
        t = np.arange(windows.shape[1])
        turned = np.maximum(sizes[None, :] - 1 - t[:, None], 0)
        back = h[1][turned, np.arange(len(sizes))[None, :]]
        logits = h[0] @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, h, back, x, turned

    def gradient(self, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        trace: list = []
        p, h, back, x, turned = self.positions(windows, sizes, trace)
        steps, many, k = p.shape
        n, live = self.units, np.arange(steps)[:, None] < sizes[None, :]
        total = live.sum()
        own = p[:, np.arange(many), labels]
        loss = -float((np.log(np.maximum(own, 1e-12)) * live).sum() / total)
        d = p
        d[:, np.arange(many), labels] -= 1
        d *= (live / total)[:, :, None]
        flat = d.reshape(-1, k)
        out = np.stack([h[0].reshape(-1, n).T @ flat, back.reshape(-1, n).T @ flat])
        bias = flat.sum(axis=0)
        dh = np.zeros_like(h)
        dh[0] = d @ self.out[0].T
        np.add.at(dh[1], (turned, np.broadcast_to(np.arange(many), turned.shape)), (d @ self.out[1].T) * live[:, :, None])
        embed, gates, cand = np.zeros_like(self.embed), np.zeros_like(self.gates), np.zeros_like(self.cand)
        after = np.zeros((2, many, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, c = trace[t]
            g = after + dh[:, t]
            dc = g * z * (1 - c * c)
            drh = dc @ self.cand.transpose(0, 2, 1)
            dz, dr = g * (c - before) * z * (1 - z), drh * before * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=2)
            cand += (r * before).transpose(0, 2, 1) @ dc
            gates += before.transpose(0, 2, 1) @ dzr
            all_ = np.concatenate([dzr, dc], axis=2)
            for way in (0, 1):
                np.add.at(embed[way], x[way, t], all_[way])
            after = g * (1 - z) + drh * r + dzr @ self.gates.transpose(0, 2, 1)
        return loss, [embed, gates, cand, out, bias]

    def fit(self, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.02, batch: int = 128, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        sums = [(np.zeros_like(getattr(self, c)), np.zeros_like(getattr(self, c))) for c in self.NAMES]
        turn, epochs = 0, max(1, -(-steps * batch // len(labels)))
        last = epochs * -(-len(labels) // batch)
        for _ in range(epochs):
            order = r.permutation(len(labels))
            for part in np.split(order, range(batch, len(order), batch)):
                _, grads = self.gradient(windows[part], sizes[part], labels[part])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                turn += 1
                step = rate * (1 - turn / (last + 1)) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for name, g, (m, v) in zip(self.NAMES, grads, sums, strict=True):
                    g = g * min(1.0, 1.0 / (size + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    getattr(self, name).__isub__((step * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        return self

    def pooled(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean probabilities of all positions of each text; an empty text has equal ones."""
        k = len(self.languages)
        total, lengths = np.zeros((len(texts), k)), np.array([len(t) for t in texts])
        many = -(-lengths // window)
        owner = np.repeat(np.arange(len(texts)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        padded = np.frombuffer(b"".join(t + bytes(m * window - len(t)) for t, m in zip(texts, many.tolist(), strict=True)), np.uint8).reshape(-1, window)
        sizes = np.minimum(window, lengths[owner] - place * window)
        for at in range(0, len(owner), BLOCK):
            here = slice(at, at + BLOCK)
            p = self.positions(padded[here], sizes[here])[0]
            p *= (np.arange(window)[:, None] < sizes[here][None, :])[:, :, None]
            np.add.at(total, owner[here], p.sum(axis=0, dtype=np.float64))
        return np.where(lengths[:, None] > 0, total / np.maximum(lengths, 1)[:, None], 1 / max(1, k))


def training_windows(docs: DataFrame, known: Column, sample: int = SAMPLE, languages: int = LANGUAGES, window: int = WINDOW, seed: int = SEED) -> tuple[list[str], list]:
    """The languages of the rows where known holds, the `languages` most frequent at most, and about `sample` windows of
    each: (bytes, number of the language), in an order of their own. docs: doc_id, text, lang."""
    rows = docs.where(known & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    many = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in many)
    if not names:
        return [], []
    takes = {r["lang"]: min(TAKES, -(-2 * sample // r["n"])) for r in many}
    of = lambda pairs: F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), F.col("lang"))
    share = of((r["lang"], min(1.0, 2 * sample / (r["n"] * takes[r["lang"]]))) for r in many)
    drawn = rows.withColumn("_take", F.explode(F.sequence(F.lit(1), of(takes.items()))))
    key = F.xxhash64(F.lit(seed), "_take", "doc_id", "text")
    drawn = drawn.select("lang", F.col("text").cast("binary").alias("_b"), key.alias("_key"), share.alias("_share"))
    drawn = drawn.where(F.pmod("_key", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    start = 1 + F.pmod(F.shiftright("_key", 20), F.greatest(F.lit(1), F.octet_length("_b") - window + 1)).cast("int")
    drawn = drawn.select("lang", "_key", F.substr("_b", start, F.lit(window)).alias("_window")).dropDuplicates(["lang", "_window"])
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("lang").orderBy("_key", "_window"))
    got = drawn.withColumn("_nth", order).where(F.col("_nth") <= sample).collect()
    number = {n: i for i, n in enumerate(names)}
    return names, sorted((bytes(r["_window"]), number[r["lang"]]) for r in got)


def train(docs: DataFrame, known: Column, units: int = UNITS, window: int = WINDOW, steps: int = STEPS, **kw) -> Network:
    """A network fitted on training_windows; without any it knows no language."""
    names, rows = training_windows(docs, known, window=window, **kw)
    net = Network(names, units)
    if not rows:
        return net
    sizes = np.array([len(b) for b, _ in rows])
    table = np.frombuffer(b"".join(b.ljust(window, b"\0") for b, _ in rows), np.uint8).reshape(-1, window)
    return net.fit(table, sizes, np.array([y for _, y in rows]), steps=steps)


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is the language of the greatest pooled probability, the first by name of equals, and score that probability.
    A text that is null, empty or without a letter, and any text if no language was learnt, is `und` with score 0. Rows that
    are held out, and rows without a language, are not learnt from. Repeated rows are predicted alike; bytes that aren't
    UTF-8 are read as they are; an empty table gives no rows; other columns don't matter.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = docs.sparkSession.sparkContext.broadcast(net or train(docs, ~held_out()))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        net = held.value
        for own, texts, has in batches(rows, 4 << 20):
            read = [t if h and net.languages else b"" for t, h in zip(texts, has, strict=True)]
            p = net.pooled(read)
            best = p.argmax(axis=1) if net.languages else [0] * len(read)
            names = [net.languages[i] if t else UNKNOWN for i, t in zip(best, read, strict=True)]
            scores = [round(float(p[k, i]), 9) if t else 0.0 for k, (i, t) in enumerate(zip(best, read, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has")
    found = docs.select("doc_id", "text", has).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
