"""Steps that regional queries share: made once, with the rows of the plain forms, without joins of a table with itself."""

import pytest
from pyspark.sql import functions as F

from tidechart import bindings, queries
from tidechart.operators import snapshots
from tidechart.operators.smoothing import Smoothed
from tidechart.plans import regional


def rows(df, *names):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=repr)


def test_latest_entries_are_those_of_all_entries(spark, small):
    rel = queries.Rel(spark, small)
    want = snapshots.latest_snapshot(rel("chart_entries"), ["chart_id"], "snapshot_id")
    assert want.where("previous_rank IS NOT NULL").count() > 0
    assert rows(rel("latest_entries"), *want.columns) == rows(want, *want.columns)


def test_lines_meet_orders_once(spark, small, monkeypatch):
    written = []
    real = bindings.materialized
    monkeypatch.setattr(bindings, "materialized", lambda df, name="rows": written.append(name) or real(df, name))
    rel = queries.Rel(spark, small)
    queries._item_scores(rel), queries._plays(rel), queries._votes(rel), queries._evidence(rel), queries._trending(rel)
    assert written.count("sold") == 1
    for flag in "RA":
        assert "l_orderkey" not in queries._sold(rel, flag)._jdf.queryExecution().optimizedPlan().toString()
    assert queries._evidence(rel) is queries._evidence(rel)


def test_charts_keep_two_months_before_they_sum(spark, small, monkeypatch):
    sizes = {}
    real = bindings.materialized

    def counted(df, name="rows"):
        out = real(df, name)
        sizes[name] = out.select("month_no", "chart_id").distinct().groupBy("chart_id").count().agg(F.max("count")).first()[0] if name == "charts" else None
        return out

    monkeypatch.setattr(bindings, "materialized", counted)
    queries._national(queries.Rel(spark, small)).count()
    assert sizes["charts"] == 2


def test_lifts_of_own_cells(spark):
    counts = spark.createDataFrame([("r", "x", 4.0), ("r", "y", 1.0), ("s", "x", 2.0), ("s", "z", 0.0)], "region string, item string, v double")
    own = Smoothed(counts, "region", "item", "v", 10.0)
    got = own.lifts("s")
    assert rows(got, "region", "item", "v", "s", "s_lift") == rows(own.over(counts.select("region", "item"), "s"), "region", "item", "v", "s", "s_lift")
    assert "Join Inner, ((region" not in got._jdf.queryExecution().optimizedPlan().toString().replace("#", " ")


def test_shares_of_places_with_one_name(spark, tmp_path, small):
    for name in bindings.TABLES:
        df = spark.read.parquet(f"{small}/{name}.parquet")
        # two nations of a region by one name, a third by that name elsewhere
        df = df.withColumn("n_name", F.when(F.col("n_nationkey").isin(0, 5, 1), "TWIN").otherwise(F.col("n_name"))) if name == "nation" else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    want = bindings.spark_relation(spark, str(tmp_path), "shares", {}).selectExpr("fine", "coarse", "item", "double(share) share")
    got = bindings.spark_relation(spark, str(tmp_path), "trend_obs", {})
    assert rows(got, "fine", "coarse", "item", "share") == rows(want, "fine", "coarse", "item", "share")


@pytest.mark.parametrize("lift, want", [(4.0, ("y", 5.0)), (9.0, ("x", 9.0))])
def test_favourite_is_the_greater_lift_of_a_cell(spark, lift, want):
    none = spark.createDataFrame([], "region string, genre string, plays long, mentions double")
    ranked = spark.createDataFrame([("r", "y", 1)], "region string, item string, rank int")
    interest = spark.createDataFrame([("r", "x", lift), ("r", "y", 1.4), ("q", "x", 1.2)], "region string, item string, trend_lift double")
    comments = spark.createDataFrame([("r", "y", 5.0, 9, 1), ("r", "z", 99.0, 1, 1)], "region string, item string, c_share_lift double, authors long, self_mentions long")
    regions = spark.createDataFrame([("r",), ("q",)], "region string")
    got = regional.region_profile(regions, none, ranked, interest, comments, regions.withColumn("plays", F.lit(1)))
    assert {r.region: (r.favourite, r.favourite_lift) for r in got.collect()} == {"r": want, "q": (None, None)}
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
