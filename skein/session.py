"""What operators need from the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, that all executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="skein-"))
    return folder


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder; a folder that is set already is kept."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, computed once and held as Parquet in the shared folder until the block ends."""
    spark, place = df.sparkSession, f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(place)
    try:
        yield spark.read.schema(df.schema).parquet(place)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows in a partition for each core at least: few files, or small ones, would leave the others idle."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
