"""The raw lake replayed as a stream: restarts, failures, late files, days."""

import pytest
from pyspark.sql import functions as F

from tidechart.sources import lake, replay, sinks
from tidechart.streaming import jobs

AT = 1_700_000_000_000
SCHEMA = "event_id long, user_id string, region string, item string, action string, ts_ms long"
ONCE = {"availableNow": True}


def put(spark, base, ids, topic="events", day=0):
    rows = [(i, f"u{i % 3}", "r", f"i{i % 2}", "play", AT + i * 7000 + day * 86_400_000) for i in ids]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    lake.seed_lake(df, base, F.lit(topic), F.col("ts_ms"))


def run(stream, out, ck, fail=False):
    def each(df, _):
        if fail:
            raise RuntimeError("planned")
        df.write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", ck).trigger(**ONCE).start()
    q.awaitTermination(120)


def ids(spark, out):
    return sorted(r["v"] for r in spark.read.parquet(out).select(F.get_json_object("value", "$.event_id").cast("long").alias("v")).collect())


def test_each_row_once_over_restarts_and_a_failure(spark, tmp_path):
    base, out, ck = (str(tmp_path / x) for x in ("lake", "out", "ck"))
    stream = lambda: replay.replay(spark, base, "events", settle=0)
    put(spark, base, range(10))
    put(spark, base, range(100, 105), "other")
    run(stream(), out, ck)
    assert ids(spark, out) == list(range(10))
    put(spark, base, range(10, 15), day=1)
    with pytest.raises(Exception, match="planned"):
        run(stream(), out, ck, fail=True)
    # of an earlier day, and later than the batch that failed
    put(spark, base, range(15, 20), day=-1)
    run(stream(), out, ck)
    run(stream(), out, ck)
    assert ids(spark, out) == list(range(20))
    days = {r["dt"] for r in spark.read.parquet(out).select("dt").collect()}
    assert days == {"2023-11-13", "2023-11-14", "2023-11-15"}


def test_days_before_are_left_out_and_young_files_wait(spark, tmp_path):
    base = str(tmp_path / "lake")
    put(spark, base, range(5))
    put(spark, base, range(5, 8), day=1)
    run(replay.replay(spark, base, "events", "2023-11-15", settle=0), str(tmp_path / "a"), str(tmp_path / "cka"))
    assert ids(spark, str(tmp_path / "a")) == [5, 6, 7]
    reader = replay.LakeReader(f"file://{base}", "events", "", 3600.0)
    assert reader.latestOffset() == replay.START and reader.partitions(replay.START, replay.START) == []
    assert replay.LakeReader(f"file://{base}", "none", "", 0.0).latestOffset() == replay.START


def test_counts_of_a_replay_are_those_of_the_batch(spark, tmp_path):
    base, out, ck = (str(tmp_path / x) for x in ("lake", "out", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for lo in (0, 30):
        put(spark, base, range(lo, lo + 30))
        stream = lake.valid_events(lake.parse_stream(replay.replay(spark, base, "events", settle=0), schema), ["event_id"])
        jobs.keyed_sink(jobs.plays_per_minute(stream), out, "plays", "last_ts_ms", ck, trigger=ONCE).awaitTermination(120)
    got = {tuple(r) for r in sinks.read_upserted(spark, out, "plays").select("doc_id", "plays").collect()}
    batch = lake.valid_events(lake.read_raw(spark, base, "events", schema), ["event_id"])
    assert got == {tuple(r) for r in jobs.plays_docs(jobs.plays_by_minute(batch)).select("doc_id", "plays").collect()}


def test_options_of_sources():
    assert lake.stream_options("kafka", 500) == {"startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": 500}
    assert lake.stream_options("parquet", 3) == {"maxFilesPerTrigger": 3}
