"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidechart.operators.materialize import Rounds


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root): the least node that each node of `links` reaches. Nodes without links are absent.

    Each step rewires edges to smaller nodes, so the number of steps grows with the logarithm of a path's
    length. Edges of a hub are never gathered: every step is a least-value aggregation and a join. More than
    `rounds` steps are an error, never a partial answer.
    """
    steps = Rounds(links.sparkSession, "components", keep=3)
    edges = steps.put(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tops = least.where("m < u").select("u", F.col("m").alias("v"))
        wide = steps.put(large.unionByName(tops).where("u != v").distinct())
        # small star: smaller neighbours and the node itself go to the least of them
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = steps.put(small.where("u != v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle within {rounds} steps")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
