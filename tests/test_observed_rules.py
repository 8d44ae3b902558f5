"""Data-quality rules that are counted as rows pass, in batches and streams."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

from tidechart.operators.snapshots import quality_report, with_rules
from tidechart.sources import sinks
from tidechart.streaming import jobs

SCHEMA = "doc_id string, rank int, share double"


def rules():
    return {"rank_in_chart": F.col("rank").between(1, 50), "share_not_negative": F.col("share") >= 0}


ROWS = [("a", 1, 0.5), ("b", 51, 0.1), ("c", None, -1.0), ("d", 7, None)]


def wait_for(log, n):
    for _ in range(150):
        if len(log.rules) >= n:
            return
        time.sleep(0.1)


@pytest.mark.parametrize("sink", ["files", "keyed"])
def test_broken_rules_of_each_batch_of_a_stream(spark, tmp_path, sink):
    for k, rows in enumerate([ROWS, ROWS[:2], ROWS[:1]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    log = sinks.ProgressLog()
    spark.streams.addListener(log)
    try:
        own = with_rules(stream, rules(), sink)
        if sink == "files":
            q = own.writeStream.format("parquet").queryName("observed").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        else:
            q = jobs.keyed_sink(own, str(tmp_path / "out"), "t", "rank", str(tmp_path / "ck"), "append", {"availableNow": True})
        q.awaitTermination(120)
        wait_for(log, 6)
        log.flush(spark, str(tmp_path / "m"))
    finally:
        spark.streams.removeListener(log)
    told = spark.read.parquet(f"{tmp_path}/m/_rules").where(F.col("place") == sink)
    got = {r.rule: (r.checked, r.broken) for r in told.groupBy("rule").agg(F.sum("checked").alias("checked"), F.sum("broken").alias("broken")).collect()}
    assert got == {"rank_in_chart": (7, 3), "share_not_negative": (7, 2)}
    assert told.select("batch_id").distinct().count() == 3 and not log.rules


def test_rules_of_a_batch_agree_with_the_report(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    report = {r.rule: (r.checked, r.broken) for r in quality_report(df, rules()).collect()}
    assert report == {"rank_in_chart": (4, 2), "share_not_negative": (4, 2)}
    told = Observation("x")
    assert df.observe(told, F.count_if(~F.coalesce(rules()["rank_in_chart"], F.lit(False))).alias("n")).count() == 4 and told.get["n"] == 2
    assert with_rules(df, rules()).count() == 4
