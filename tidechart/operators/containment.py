"""Which names hold which others, by an index of their letter runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized

#: Letters of a run; shorter names are held by none.
Q = 3


def containments(names: DataFrame, block: str, name: str, q: int = Q) -> DataFrame:
    """block, holder, held: pairs of distinct names of a block of which one holds the other, each name with itself too.

    A name that is held has all its runs of q letters in its holder, so it is looked up by the one of them that fewest
    names of its block have, and what is found there is compared. Names without a common run never meet.
    """
    own = names.select(F.col(block).alias("block"), F.col(name).alias("name")).where(F.length("name") >= q).distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - q + 1), lambda i: F.substring(F.col("name"), i, F.lit(q))))
    index = materialized(own.select("block", "name", F.explode(runs).alias("run")), "runs")
    sizes = index.groupBy("block", "run").agg(F.count("*").alias("n"))
    rarest = index.join(sizes, ["block", "run"]).groupBy("block", "name").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    met = rarest.withColumnRenamed("name", "held").join(index.withColumnRenamed("name", "holder"), ["block", "run"]).where(F.contains("holder", F.col("held")))
    return met.select(F.col("block").alias(block), "holder", "held")
