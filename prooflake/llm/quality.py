"""Quality classifier: regularised quadratic discriminant over document statistics.

features() measures whole texts; fit() takes class means and covariances from exact integer moments that Spark sums over
every labelled training row, shrinks each covariance towards the pooled one and a multiple of the identity, and keeps
the inverse Cholesky factors; score() is the logistic of the log-density difference
    log p1 - log p0 - |L1^-1 (x - m1)|^2 / 2 + |L0^-1 (x - m0)|^2 / 2 - log det L1 + log det L0.
Only text is measured: neither labels, language, source nor id enter a score.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, released

THRESHOLD = 0.3
#: Rows whose texts keep_good holds beside their batch.
ROWS = 512
#: Weight of the pooled covariance, and of the identity times the mean variance.
POOL, RIDGE = 0.05, 0.02
#: Features are whole multiples of 1/UNIT, so that sums of moments don't depend on their order.
UNIT = 1024
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*|@^~<>{}[]=+_\\/"
_LOUD = b"!?"
_STOPS = b".,;:"
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
NAMES = ("size", "word_length", "upper", "digits", "symbols", "loud", "stops", "high", "distinct", "echo", "pairs", "top", "lines", "line_length")


def measure(text: bytes | None) -> list[int]:
    """Statistics of a text in UTF-8, in units of 1/UNIT. An empty text has size 0 and no other mark."""
    b = text or b""
    n = len(b)
    if not n:
        return [0] * len(NAMES)
    words = b.split()
    w = max(1, len(words))
    share = lambda drop: math.log1p(200 * (n - len(b.translate(None, drop))) / n)
    lines = [x for x in b.split(b"\n") if x]
    seen = Counter(words)
    echo = sum(map(operator.eq, words, islice(words, 1, None)))
    pairs = len(set(zip(words, islice(words, 1, None), strict=False)))
    values = (
        math.log1p(n) / 4,
        math.log1p(len(b.translate(None, _SPACE)) / w),
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        share(_LOUD),
        share(_STOPS),
        share(_HIGH),
        math.log1p(len(seen)) - math.log1p(w),
        math.log1p(200 * echo / w),
        math.log1p(20 * (1 - (pairs + 1) / w)),
        math.log1p(100 * max(seen.values(), default=0) / w) / 4,
        math.log1p(20 * (1 - len(set(lines)) / max(1, len(lines)))),
        math.log1p(n / max(1, len(lines))) / 4,
    )
    return [round(UNIT * v) for v in values]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<int>) for each row of docs; a null text is empty."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([measure(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<int>")


@dataclass
class Model:
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of features in UNIT."""
        x = x / UNIT
        of = [self.log_prior[c] - self.log_det[c] - ((x - self.mean[c]) @ self.factor[c].T).__pow__(2).sum(axis=1) / 2 for c in (0, 1)]
        return np.round(1 / (1 + np.exp(-np.clip(of[1] - of[0], -500, 500))), 9)


def fit(rows: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Model:
    """rows: x array<int>, label 0 or 1; rows with any other label are left out. A class without rows gets the other's
    moments, so that scores then are 0.5."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = [F.sum(x[i].cast("long")).alias(f"s{i}") for i in range(d)] + [F.sum(x[i].cast("long") * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r["label"]: r for r in rows.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    n, mean, cov = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c, r in got.items():
        n[c] = r["n"]
        mean[c] = [r[f"s{i}"] / r["n"] / UNIT for i in range(d)]
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = r[f"p{i}_{j}"] / r["n"] / UNIT**2 - mean[c, i] * mean[c, j]
    for c in (0, 1):
        if not n[c]:
            n[c], mean[c], cov[c] = max(1, n[1 - c]), mean[1 - c], cov[1 - c]
    common = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factor, log_det = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        shrunk = (1 - pool) * cov[c] + pool * common
        shrunk = (1 - ridge) * shrunk + ridge * (np.trace(common) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(shrunk)
        factor[c] = np.linalg.inv(low)
        log_det[c] = np.log(np.diag(low)).sum()
    return Model(mean, factor, log_det, np.log(n / n.sum()))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(x: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fit on the rows of x that aren't held out and have a label; of several labels the more frequent counts, of equally
    many the 1."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    return fit(x.join(known, x.doc_id == known._id).select("x", "label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. Empty and null texts are scored like any other;
    repeated rows get equal scores; without labels all scores are 0.5. An empty table gives no rows."""
    x = cut(features(docs))
    model = train(x, labels, label_col)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            if b.num_rows:
                table = np.array(b.column(1).to_pylist(), float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(table))], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality") -> DataFrame:
    """docs without the rows that the classifier rejects. Texts are measured again where they are, rather than moved. Empty and
    null texts are judged like any other, repeated rows alike; without labels all are kept; an empty table gives no rows."""
    model = train(cut(features(docs)), labels, label_col)
    at = docs.columns.index("text")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in rows:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                x = np.array([measure(t) for t in b.column(at).cast(pa.binary()).to_pylist()], float)
                yield b.filter(pa.array(model.score(x) >= threshold))
        released()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
