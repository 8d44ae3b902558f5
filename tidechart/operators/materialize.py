"""Intermediate results that several branches of a query read, written once to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error, since
    executors do not see the driver's folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """`df` as files at `path`, in folders by some columns; they are deleted when the session's JVM ends."""
    spark = df.sparkSession
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame, name: str = "rows") -> DataFrame:
    """`df` as files: its plan runs once, however often the result is read, and lost tasks start from the files."""
    return written(df, f"{shared_folder(df.sparkSession)}/tidechart-{uuid.uuid4().hex}/{name}")


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """`df` in parts of some `rows`, by columns or evenly: small files of costly rows are not one task's work."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


class Rounds:
    """Results of an iteration. Each is written; those that no later round can read are deleted."""

    def __init__(self, spark: SparkSession, name: str, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []
        self.base = f"{shared_folder(spark)}/tidechart-{uuid.uuid4().hex}/{name}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}-{self.n}"
        out = written(df, path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            removed(self.spark, self.paths.pop(0))
        return out
