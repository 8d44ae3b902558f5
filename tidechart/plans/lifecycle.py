"""Life cycles of tracks kept up to date: facts by chart and item in a keyed view, changed by new periods alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.functions.scoring import doc_id
from tidechart.operators.materialize import materialized
from tidechart.plans.insights import chart_ends, lifecycle_facts, lifecycle_status
from tidechart.sources.keyed import has_table, read_upserted, upsert

FACTS, ENDS = "lifecycle_facts", "lifecycle_ends"


def append_periods(charts: DataFrame, base: str) -> None:
    """Take in periods after those that the view has. charts: as of track_lifecycle.

    Old facts are read for the keys that come, and only changed facts are written. Periods of a chart come in order:
    one that the chart or an item of it is past changes nothing, so a batch that is taken in again, after a crash in the
    middle too, has no effect. Rows without a period are left out.
    """
    spark = charts.sparkSession
    new = charts.where(F.col("period").isNotNull())
    known = has_table(spark, base, FACTS)
    if has_table(spark, base, ENDS):
        past = read_upserted(spark, base, ENDS).select("chart", F.col("end").alias("__end"))
        new = new.join(past, "chart", "left").where("__end IS NULL OR period > __end").drop("__end")
    new = materialized(new, "periods")
    if known:
        keys = new.select("chart", "item").distinct()
        old = materialized(read_upserted(spark, base, FACTS).drop("doc_id").join(keys, ["chart", "item"], "left_semi"), "facts")
        fresh = new.join(old.select("chart", "item", "last_period"), ["chart", "item"], "left").where("last_period IS NULL OR period > last_period").drop("last_period")
        # a fact for the old periods and one for the new
        both = lifecycle_facts(fresh).unionByName(old)
        merged = both.groupBy("chart", "item").agg(
            F.min("best_rank").alias("best_rank"), F.sum("periods").alias("periods"), F.max("last_period").alias("last_period"), F.min("first_period").alias("first_period"),
            F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, 3).alias("recent"),
        )
    else:
        merged = lifecycle_facts(new)
    upsert(merged.withColumn("doc_id", doc_id("chart", "item")), base, FACTS, "doc_id", "last_period")
    upsert(chart_ends(new), base, ENDS, "chart", "end")


def lifecycle_view(spark: SparkSession, base: str, stable_range: int = 3) -> DataFrame:
    """What track_lifecycle says of all periods that were taken in."""
    return lifecycle_status(read_upserted(spark, base, FACTS).drop("doc_id"), read_upserted(spark, base, ENDS), stable_range)
