"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that all executors share."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most bytes of an Arrow batch between Spark and Python; one row at least.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays."""
    now = SparkContext._active_spark_context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give a worker's free memory back: Spark keeps the process for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and the offsets of its rows (nulls are empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each, and one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps. Both send a node's neighbours to their minimum,
    which halves paths, so the rounds grow with the logarithm of the longest path. The minimum is
    a plain partial aggregate and comes back by a join that may be split, so a hub is never gathered
    in one task. Each round is checkpointed. Edges without a partner give no rows.
    """
    e = checkpoint(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = checkpoint(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h"), F.countDistinct("u").alias("d")).first()
        if tuple(row) == before:
            if row["n"] != row["d"]:
                raise RuntimeError("components did not become stars")
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(row)
    raise RuntimeError("components did not converge")
