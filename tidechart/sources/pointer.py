"""A small table of what is published, replaced in one step.

Each state is a numbered folder; the greatest number whose write has ended is the state. A reader sees the old
state or the new one, never neither, and a writer that dies leaves the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def fs_of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = fs_of(spark, path)
    fs.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    fs, where = fs_of(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    fs, where = fs_of(spark, path)
    return [p.getPath().getName() for p in fs.listStatus(where)] if fs.exists(where) else []


def _states(spark: SparkSession, root: str) -> list[int]:
    fs, where = fs_of(spark, root)
    if not fs.exists(where):
        return []
    names = [p.getPath().getName() for p in fs.listStatus(where)]
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and whole(n))


def published(spark: SparkSession, root: str, schema: str) -> list[Row]:
    """The rows of the last state; none before the first."""
    done = _states(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{done[-1]:012d}").collect() if done else []


def publish(rows: DataFrame, root: str, keep: int = 2) -> None:
    """Make `rows` the state. The last `keep` states stay, for readers that have begun. One writer at a time."""
    spark = rows.sparkSession
    done = _states(spark, root)
    n = (done[-1] if done else 0) + 1
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/{n:012d}")
    for old in [*done, n][:-keep]:
        delete(spark, f"{root}/{old:012d}")
