"""Ranks and maxima of few, long groups, and costly rows in small files, without a task that holds them all."""

from pyspark.sql import functions as F

from tidechart import queries
from tidechart.operators.ranking import over_best, ranked
from tidechart.plans import serving


def test_ranked_by_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), (F.col("id") * 7919 % 50).alias("v"), "id")
    got = {r["id"]: (r["rank"], r["size"]) for r in ranked(df, ["g"], [F.desc("v"), F.col("id")], "rank", "size", rows=100).collect()}
    want = {}
    for k in range(3):
        own = sorted((i for i in range(3000) if i % 3 == k), key=lambda i: (-(i * 7919 % 50), i))
        want |= {i: (at + 1, len(own)) for at, i in enumerate(own)}
    assert got == want


def test_over_best(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 0.0), (None, 2.0)], "g string, v double")
    assert sorted(((r.g, r.v, r.o) for r in over_best(df, "v", ["g"], "o").collect()), key=repr) == [("a", 1.0, 0.25), ("a", 4.0, 1.0), ("b", 0.0, None), (None, 2.0, 1.0)]


def test_merged_ranks_hold_no_region_in_a_task(spark):
    batch = spark.createDataFrame([("r", i, i, float(9 - i), 1.0, 0.0, 0.0, 0.0) for i in range(1, 5)], "region string, item long, rank int, score double, c_national double, c_trends double, c_mentions double, c_events double")
    plays = spark.createDataFrame([("r", 9, 3, 0)], "region string, item long, plays long, likes long")
    mentions = spark.createDataFrame([("r", 4, 2.0)], "region string, item long, mentions double")
    got = serving.merge_trending(batch, plays, mentions)
    assert [r.item for r in got.orderBy("rank").collect()] == [9, 4, 1, 2, 3]
    assert "row_number() windowspecdefinition(region" not in got._jdf.queryExecution().analyzed().toString()


def test_forms_are_not_one_task(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "FORMS_A_PART", 50)
    assert queries.QUERIES["title_forms"](spark, small).rdd.getNumPartitions() >= 4
    monkeypatch.setattr(queries, "FORMS_A_PART", 5)
    assert queries.QUERIES["event_forms"](spark, small).rdd.getNumPartitions() >= 4


def test_ranked_sends_rows_once(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 50).alias("v"), "id")
    got = ranked(df, ["g"], [F.desc("v"), F.col("id")], "rank", rows=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and plan.count("Window") <= 1
    first = sorted((r.g, r["rank"], -r.v, r["id"]) for r in got.collect())
    assert [x[:2] for x in first] == [(g, i + 1) for g in (0, 1) for i in range(250)] and first == sorted(first, key=lambda x: (x[0], x[2], x[3]))


def test_merged_scores_are_rounded_before_the_sort(spark, monkeypatch):
    orders = []
    monkeypatch.setattr(serving, "ranked", lambda df, by, order: orders.extend(map(str, order)) or ranked(df, by, order))
    batch = spark.createDataFrame([("r", 1, 1, 2.0, 1.0, 0.0, 0.0, 0.0)], "region string, item long, rank int, score double, c_national double, c_trends double, c_mentions double, c_events double")
    plays = spark.createDataFrame([("r", 9, 3, 0)], "region string, item long, plays long, likes long")
    mentions = spark.createDataFrame([("r", 4, 2.0)], "region string, item long, mentions double")
    got = serving.merge_trending(batch, plays, mentions, "realtime")
    assert "round(" not in orders[0] and [r.item for r in got.orderBy("rank").collect()] == [9, 4]
