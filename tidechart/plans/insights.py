"""Insights over ranked lists and engagement: life cycles, list exposure, country comparison, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.functions.scoring import placement_score
from tidechart.operators.materialize import spread
from tidechart.operators.ranking import lag_join, skip_rate
from tidechart.operators.snapshots import completeness, dedup, dedup_latest

#: Rows of charts whose life cycles one task tells.
LIFE_ROWS = 100_000


def lifecycle_facts(charts: DataFrame) -> DataFrame:
    """chart, item, best_rank, periods, last_period, first_period, recent: the last three (period, rank), newest first."""
    own = charts.where(F.col("period").isNotNull())
    back = W.partitionBy("chart", "item").orderBy(F.desc("period"))
    last3 = own.withColumn("__r", F.row_number().over(back)).where("__r <= 3").groupBy("chart", "item").agg(F.sort_array(F.collect_list(F.struct("period", "rank")), asc=False).alias("recent"))
    told = charts.groupBy("chart", "item").agg(F.min("rank").alias("best_rank"), F.count("period").alias("periods"), F.max("period").alias("last_period"), F.min("period").alias("first_period"))
    return told.join(last3, ["chart", "item"], "left")


def chart_ends(charts: DataFrame) -> DataFrame:
    """chart, end, is_complete: the last period of each chart, and whether it is whole."""
    own = charts.where(F.col("period").isNotNull())
    ends = own.groupBy("chart").agg(F.max("period").alias("end"))
    return ends.join(completeness(own, ["chart", "period"], "item", "rank", "chart_size").select("chart", F.col("period").alias("end"), "is_complete"), ["chart", "end"])


def lifecycle_status(facts: DataFrame, ends: DataFrame, stable_range: int = 3) -> DataFrame:
    """chart, item, status, best_rank, periods, last_period, first_period."""
    r1, r2, r3 = (F.get("recent", F.lit(k))["rank"] for k in range(3))
    spread = F.greatest(r1, r2, r3) - F.least(r1, r2, r3)
    trend = F.when(F.col("periods") < 3, "insufficient_data").when((r3 > r2) & (r2 > r1), "rising").when((r3 < r2) & (r2 < r1), "falling").when(spread <= stable_range, "stable").otherwise("fluctuating")
    left = (F.col("last_period") < F.col("end")) & F.col("is_complete")
    status = F.when(F.coalesce(left, F.lit(False)), "left_chart").otherwise(trend)
    return facts.join(ends, "chart", "left").select("chart", "item", status.alias("status"), "best_rank", "periods", "last_period", "first_period")


def track_lifecycle(charts: DataFrame, stable_range: int = 3) -> DataFrame:
    """chart, item, status, best_rank, periods, last_period, first_period.

    charts: chart, period, item, rank, chart_size; one whole snapshot for each chart and period. Three last
    periods decide: rising, falling, stable (ranks within `stable_range`), fluctuating; fewer are
    insufficient_data. An item absent from the chart's last period is left_chart if that one is complete.
    """
    # a chart's items are dealt by number of rows, and stay where they are for all facts
    return lifecycle_status(lifecycle_facts(spread(charts, LIFE_ROWS, "chart", "item")), chart_ends(charts), stable_range)


def exposures(lists: DataFrame) -> DataFrame:
    """source, item, date, lists, placement: editorial lists that hold an item on a day, latest position each.

    lists: source, item, date, list, position, ts; positions under 1 do not count.
    """
    last = dedup_latest(lists.where(F.col("position") >= 1), ["source", "item", "date", "list"], "ts")
    return last.groupBy("source", "item", "date").agg(F.count("*").alias("lists"), F.sum(placement_score(F.col("position"))).alias("placement"))


def exposure_vs_rank(exposed: DataFrame, charts: DataFrame, lags: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """source, item, chart, date, lag_days, lists, placement, rank_before, rank_after, improvement.

    charts: source, chart, item, date, rank. A missing later period gives no row.
    """
    later = lag_join(charts, ["source", "chart", "item"], "date", lags, ["rank"])
    return exposed.join(later, ["source", "item", "date"]).withColumn("improvement", F.col("rank_before") - F.col("rank_after"))


def median_improvement(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("observations"), F.median("improvement").alias("median_improvement"))


def complete_periods(charts: DataFrame, countries: list[str]) -> tuple[DataFrame, DataFrame]:
    """(period: complete in all countries, country and period of rejected snapshots)."""
    own = completeness(charts.where(F.col("country").isin(countries)), ["country", "period"], "item", "rank", "chart_size")
    good = own.where(F.col("is_complete") & F.col("period").isNotNull())
    dates = good.groupBy("period").agg(F.countDistinct("country").alias("__n")).where(F.col("__n") == len(set(countries))).select("period")
    return dates, own.where(~F.col("is_complete") | F.col("period").isNull()).select("country", "period")


def compare_countries(charts: DataFrame, countries: list[str], n: int = 50, period: str | None = None) -> DataFrame:
    """item, country, rank, rank_score, stream_share: items in the first n anywhere, in the same period.

    The period is the last that all countries have whole, unless given. An item that a country's chart lacks
    has no values there, not 0. Shares are of the whole chart.
    """
    dates, _ = complete_periods(charts, countries)
    chosen = dates.where(F.col("period") == period) if period is not None else dates.agg(F.max("period").alias("period"))
    own = charts.where(F.col("country").isin(countries)).join(chosen, "period", "left_semi")
    total = F.sum("metric_value").over(W.partitionBy("country"))
    size = F.count("*").over(W.partitionBy("country"))
    scored = own.select("item", "country", "rank", ((size - F.col("rank") + 1) / size).alias("rank_score"), F.try_divide("metric_value", total).alias("stream_share"))
    wanted = scored.where(F.col("rank") <= n).select("item").distinct()
    grid = wanted.crossJoin(own.select("country").distinct())
    return grid.join(scored, ["item", "country"], "left")


def feedback_summary(events: DataFrame, group: Column, source: str | None = None) -> DataFrame:
    """grp, play, skip, likes, skip_rate, users, events: each event id once, sources kept apart."""
    own = dedup(events.where(F.col("action").isin("play", "skip", "like") & F.col("event_id").isNotNull()), ["event_id"])
    if source is not None:
        own = own.where(F.coalesce("source", F.lit("unknown")) == source)
    count = lambda a: F.count_if(F.col("action") == a)
    return own.groupBy(F.coalesce(group.cast("string"), F.lit("unknown")).alias("grp")).agg(count("play").alias("play"), count("skip").alias("skip"), count("like").alias("likes"), skip_rate().alias("skip_rate"), F.countDistinct("user_id").alias("users"), F.count("*").alias("events"))


def source_counts(events: DataFrame) -> DataFrame:
    own = dedup(events.where(F.col("action").isin("play", "skip", "like") & F.col("event_id").isNotNull()), ["event_id"])
    return own.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("events"))
