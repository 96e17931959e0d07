"""What the operators of this subpackage share: inputs, checkpoints, batches, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A machine-local folder is made only where that setting is absent, as in tests.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if at is None and current.isDefined():
        return current.get()
    if at is None:
        at = tempfile.mkdtemp(prefix="prooflake-")
    if not current.isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released() -> None:
    """Gives memory that this Python worker no longer uses back to the system; workers live on from task to task, and what
    one stage needed at most would count beside the next stage's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run with released() before its first and after its last batch."""

    def task(rows: Iterator) -> Iterator:
        released()
        yield from run(rows)
        released()

    return task


def batches(rows: Iterator, max_bytes: int = 8 << 20, text: int = 1) -> Iterator[list[list]]:
    """Arrow record batches as lists of columns, split so that the texts of one part stay near max_bytes.

    A single longer text makes a part of its own; texts are bytes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in rows:
        if not b.num_rows:
            continue
        col = b.column(text)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > max_bytes:
                yield _lists(b.slice(start, i - start), text, pa)
                start, total = i, 0
            total += n
        yield _lists(b.slice(start), text, pa)


def _lists(b, text: int, pa) -> list[list]:
    return [(c.cast(pa.binary()) if k == text and not pa.types.is_binary(c.type) else c).to_pylist() for k, c in enumerate(b.columns)]


def signed(x: int) -> int:
    """An unsigned 64-bit integer as the long that Spark holds."""
    return x - (1 << 64) if x >> 63 else x


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key is hot if it has more than one in so many of all rows; fewer than so many keys can be.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str = "n", hot_share: int = HOT_SHARE) -> DataFrame:
    """rows joined with a table that has one row for each key, with the key's number of rows in column n, which goes.

    Rows of hot keys take the table's columns from a broadcast of fewer than hot_share rows and are spread over all tasks;
    the others meet their keys in a shuffle. Rows without a key of the table go.
    """
    table = cut(table)
    total = table.agg(F.sum(n)).first()[0] or 0
    names = [c for c in table.columns if c not in (key, n)]
    hot = F.col(n) * hot_share > total
    few = F.broadcast(table.where(hot).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    many = table.where(~hot).select(F.col(key).alias("_own"), F.lit(0).alias("_spread_own"), *[F.col(c).alias(f"_own_{c}") for c in names])
    met = rows.join(few, rows[key] == F.col("_hot"), "left")
    met = met.withColumn("_spread", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")).otherwise(0))
    met = met.join(many, (F.col(key) == F.col("_own")) & (F.col("_spread") == F.col("_spread_own")), "left")
    met = met.where(F.col("_hot").isNotNull() | F.col("_own").isNotNull())
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_own_{c}").alias(c) for c in names])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    Alternating large-star and small-star rounds. A round costs two pre-aggregated minima and two equi-joins, and the
    edge table never grows; each is checkpointed. The driver sees a row count and a checksum of each round. Edges with a
    null end are left out.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38)))")).first())
