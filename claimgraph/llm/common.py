"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, always through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This process's folder under ``spark.checkpoint.dir``; a temporary one only where that is unset (tests).

    The folder goes when the driver process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if "" not in _ROOTS:
            _ROOTS[""] = tempfile.mkdtemp(prefix="claimgraph-")
        base = _ROOTS[""]
    if base not in _ROOTS:
        _ROOTS[base] = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _ROOTS[base])
    return _ROOTS[base]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session may be gone before the process
        return


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """A table written into the shared folder and read back: it cuts lineage and survives lost executors.

    The write's own shuffle files go as soon as it is done; they would else wait for the driver's garbage collector.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            # No marker file: nothing reads it, and the driver launches two processes for it.
            df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Only once nothing unread depends on it."""
        drop_path(self.spark, self.path)


def bucket_of(id_col: str, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)
