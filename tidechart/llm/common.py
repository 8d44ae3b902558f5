"""Helpers that the operators of this package share: tables, shared storage, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a step's rows to the shared folder and read them back, so that what follows starts from files.
stored = materialized


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals before each row, by group, without a group in one task.

    `bucket` is an integer column that rises with `order` inside a group. Totals by (group, bucket) are
    small; their running totals are added to those inside each bucket. `sums` maps a new column to the
    summed column. Ties in `order` must be the same row in every respect that matters.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    over = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*group, bucket, *[F.coalesce(F.sum(f"__{k}").over(over), F.lit(0)).alias(f"__{k}") for k in sums])
    renamed = before.select(*[F.col(c).alias(f"__b_{c}") for c in (*group, bucket)], *[f"__{k}" for k in sums])
    on = [df[c].eqNullSafe(renamed[f"__b_{c}"]) for c in (*group, bucket)]
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(renamed, on, "left")
    return out.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__{k}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()],
    )


def with_uid(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` with __uid, a row number that is the same in every later read.

    Ids that are unique and not null serve as they are. Otherwise rows are numbered as they are written to the
    shared folder, so that repeated rows and null ids stay apart even if a task runs again.
    """
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        shared = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")
        if shared.isEmpty():
            return docs.withColumn("__uid", F.col(id_col).cast("long"))
    return stored(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, text) of every row; see with_uid."""
    rows = with_uid(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return rows.select(F.col("__uid").alias("uid"), "id", "text")
