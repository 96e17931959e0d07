"""Exact top-k search as a Voronoi kNN join.

Vectors are cut to integers; the score is their inner product. Pivots from a bounded sample divide queries and data into
cells. Summaries per cell (radius, largest norm, and for queries the least of their k-th scores against a bounded sample of
the data) bound every score between a query cell and a data cell, and between a query cell and a single vector. A vector
is sent only to the query cells for which the bound reaches the k-th score; each cell then is solved locally in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

SCALE = 64
TOP = 20
#: Data vectors in the sample that gives first bounds; most pivots; queries and data vectors in a local block.
SAMPLE, PIVOTS, QUERIES, DATA = 2048, 256, 2048, 65536


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, m): floor(scale * x), x as double, as little-endian doubles, which hold it exactly, and the number of equal
    rows. Rows with a null id or vector, or with a null or non-finite component, are left out, and those whose product with
    the scale is not finite."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or x is None or None in x:
                    continue
                v = np.floor(np.array(x, float) * scale)
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append((v + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, v binary")
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("m"))


def _matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(-1, width)
    return np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in rows), "<f8").reshape(-1, width)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where no sum can pass 2**53, else in Python's integers, which are cut to the ends of
    a long (all but its least value, which stands for no score)."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 1 << 53:
        return (q @ x.T).astype(np.int64)
    top = np.iinfo(np.int64).max
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(whole(q), whole(x).T), -top, top).astype(np.int64)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score, row of x) of each query's k best of x, ties to the smaller id, its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rows, cols, values, places = [], [], [], []
    for i in range(0, len(q), 256):
        s = _scores(q[i : i + 256], x)
        own = q_ids[i : i + 256, None] == ids[None, :]
        worst = np.iinfo(np.int64).min
        s[own] = worst
        if len(ids) > k:
            floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            r, c = np.nonzero((s >= floor[:, None]) & (s != worst))
        else:
            r, c = np.nonzero(s != worst)
        v = s[r, c]
        o = np.lexsort((c, -v, r))
        r, c, v = r[o], c[o], v[o]
        nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = nth < k
        rows.append(r[keep] + i)
        cols.append(ids[c[keep]])
        values.append(v[keep])
        places.append(order[c[keep]])
    if not rows:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values), np.concatenate(places)


def top_k(vectors: DataFrame, every: int = 20, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best of all rows with another
    id, ties to the smaller id.

    Vectors of unlike length are compared as if the shorter ended in zeros. Of equal vectors only the k + 1 smallest ids
    can be among anybody's best, so no more of them move. Equal rows are candidates of their own, and one query. A score
    beyond a long is cut to its end. An empty table gives no rows.
    """
    data = cut(quantised(vectors, id_col, vector_col, scale))
    queries = data.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    n, nq, longest = data.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.octet_length("v"))).first()
    width = max(1, (longest or 0) // 8)
    few = data.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1).select("vec_id", "v", "m")
    sample = few.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in sample], np.int64)
    sample_x = _matrix([bytes(r["v"]) for r in sample], width)
    pivots = np.unique(sample_x, axis=0)
    pivots = pivots[:: max(1, len(pivots) // max(1, min(PIVOTS, -(-nq // 512))))].astype(float)
    if not len(pivots):
        pivots = np.zeros((1, width))

    def cell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it."""
        d = (x.astype(float) ** 2).sum(axis=1)[:, None] - 2 * x.astype(float) @ pivots.T + (pivots**2).sum(axis=1)
        near = d.argmin(axis=1)
        return near, np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)) * (1 + 1e-12)

    def query_summary(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            if not b.num_rows:
                continue
            ids, x = np.array(b.column(0).to_pylist(), np.int64), _matrix(b.column(1).to_pylist(), width)
            near, far = cell(x)
            kth = np.full(len(ids), -np.inf)
            r, _, v, _ = best(ids, x, sample_ids, sample_x, k)
            has = np.bincount(r, minlength=len(ids)) >= k
            lowest = np.full(len(ids), np.inf)
            np.minimum.at(lowest, r, v.astype(float))
            kth[has] = lowest[has]
            found = np.unique(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array([int((near == c).sum()) for c in found]), pa.array([float(far[near == c].max()) for c in found]), pa.array([float(kth[near == c].min()) for c in found])], ["cell", "n", "radius", "kth"]
            )

    def data_summary(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            if not b.num_rows:
                continue
            near, far = cell(_matrix(b.column(1).to_pylist(), width))
            found = np.unique(near)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([float(far[near == c].max()) for c in found])], ["cell", "radius"])

    groups = {r["cell"]: r for r in queries.mapInArrow(query_summary, "cell int, n long, radius double, kth double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("kth").alias("kth")).collect()}
    cells = {r["cell"]: r["radius"] for r in few.mapInArrow(data_summary, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    blocks = {c: -(-g["n"] // QUERIES) for c, g in groups.items()}
    salts = max(1, -(-n // DATA))
    slack = lambda bound: bound + 1e-6 + 1e-9 * np.abs(bound)
    size = np.sqrt((pivots**2).sum(axis=1))
    #: Data cells that can hold a best vector of some query of a query cell.
    open_ = {c: {j for j, r in cells.items() if not (slack(pivots[c] @ pivots[j] + g["radius"] * size[j] + (size[c] + g["radius"]) * r) < g["kth"])} for c, g in groups.items()}

    def send_queries(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            if not b.num_rows:
                continue
            ids = np.array(b.column(0).to_pylist(), np.int64)
            near, _ = cell(_matrix(b.column(1).to_pylist(), width))
            block = np.array([_spread(int(i)) % blocks[int(c)] for i, c in zip(ids, near, strict=True)], np.int32)
            for s in range(salts):
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(block), pa.array(np.full(len(ids), s, np.int32)), b.column(0), b.column(1), pa.array(np.ones(len(ids), np.int64))], ["cell", "block", "salt", "vec_id", "v", "m"])

    def send_data(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1).to_pylist(), width)
            near, _ = cell(x)
            norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            salt = np.array([_spread(i) % salts for i in b.column(0).to_pylist()], np.int32)
            for c, g in groups.items():
                near_enough = ~(slack(x @ pivots[c] + g["radius"] * norm) < g["kth"])
                ix = np.flatnonzero(near_enough & np.isin(near, list(open_[c])))
                for block in range(blocks[c] if len(ix) else 0):
                    part = b.take(pa.array(ix))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ix), c, np.int32)), pa.array(np.full(len(ix), block, np.int32)), pa.array(salt[ix]), part.column(0), part.column(1), part.column(2)], ["cell", "block", "salt", "vec_id", "v", "m"])

    def solve(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "m": np.zeros(0, np.int64)})
        q_ids = left["vec_id"].to_numpy(np.int64)
        vs = list(left["v"])
        r, ids, v, at = best(q_ids, _matrix(vs, width), right["vec_id"].to_numpy(np.int64), _matrix(list(right["v"]), width), k)
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": ids, "score": v, "m": right["m"].to_numpy(np.int64)[at]})

    shape = "cell int, block int, salt int, vec_id long, v binary, m long"
    keys = ["cell", "block", "salt"]
    found = queries.mapInArrow(send_queries, shape).groupBy(*keys).cogroup(few.mapInArrow(send_data, shape).groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long, m long")
    found = found.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.least("m", F.lit(k).cast("long")))))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _spread(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33


