"""Sketches of listeners by minute, united over longer spans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidechart.sources.keyed import read_upserted
from tidechart.streaming import sketches

T0 = datetime(2024, 1, 1, 10)


@pytest.fixture(scope="module")
def many(spark):
    """20,000 users an hour who come back in many minutes, and events without a user."""
    n = F.col("id")
    rows = spark.range(120_000).select(F.concat(F.lit("e"), n.cast("string")).alias("event_id"), F.when(n % 50 != 0, (F.hash(n) % 20_000).cast("long")).alias("user_id"), F.when(n % 3 == 0, "like").otherwise("play").alias("action"), F.lit("r").alias("region"), F.concat(F.lit("i"), (n % 5).cast("string")).alias("item"), (F.lit(int(T0.timestamp()) * 1000) + n * 60).alias("ts_ms"))
    return rows.withColumn("ts", F.timestamp_millis("ts_ms"))


@pytest.mark.parametrize("by", [("region",), ("region", "item")])
def test_hours_within_the_stated_error(many, by):
    got = {(r["at"], *[r[c] for c in by]): r for r in sketches.rolled_up(sketches.minute_sketches(many), "hour", by).collect()}
    want = many.groupBy(F.date_trunc("hour", "ts").alias("at"), *by).agg(F.countDistinct("user_id").alias("n"), F.count_if(F.col("action") == "play").alias("plays")).collect()
    assert len(got) == len(want)
    for w in want:
        mine = got[(w["at"], *[w[c] for c in by])]
        assert mine["plays"] == w["plays"] and abs(mine["listeners"] - w["n"]) <= 4 * 1.04 / 2 ** (sketches.LG / 2) * w["n"]


def test_hours_from_a_stream_with_repeats(spark, tmp_path):
    rows = [(f"e{k % 40}", k % 40 % 6, "play", "r", "i", T0 + timedelta(minutes=k % 40)) for k in range(80)] + [("n", None, "skip", "r", "i", T0)]
    df = spark.createDataFrame(rows, "event_id string, user_id long, action string, region string, item string, ts timestamp").withColumn("ts_ms", F.unix_millis("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sketches.stream_minute_sketches(stream, str(tmp_path / "out"), "minutes", str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination(120)
    minutes = read_upserted(spark, str(tmp_path / "out"), "minutes")
    (hour,) = sketches.rolled_up(minutes).collect()
    assert (hour["at"], hour["plays"], hour["skips"], hour["listeners"]) == (T0, 40, 1, 6)
