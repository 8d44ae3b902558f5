"""Writing: streaming ingest, versioned views, keyed upserts, run metadata, archives, progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidechart.operators.snapshots import OBSERVED
from tidechart.sources.keyed import TABLE as TABLE
from tidechart.sources.keyed import read_upserted as read_upserted
from tidechart.sources.keyed import record_id, upsert
from tidechart.sources.pointer import delete, publish, published

VIEW = "run_id string, at timestamp, seq int"


def ingest(stream: DataFrame, base: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Raw rows to Parquet by topic and day, exactly once. stream: topic, key, value, kafka_ts, partition, offset."""
    own = stream.withColumn("value", F.col("value").cast("string")).withColumn("dt", F.date_format("kafka_ts", "yyyy-MM-dd"))
    return own.writeStream.format("parquet").option("path", f"{base}/raw").option("checkpointLocation", checkpoint).partitionBy("topic", "dt").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def ingest_keyed(stream: DataFrame, base: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A mirror of raw rows under their record ids, which must be whole; replays write the same rows again."""
    put = lambda df, _: upsert(df.withColumn("doc_id", record_id()), base, name, "doc_id", "offset")
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def write_view(df: DataFrame, base: str, name: str, run_id: str, at: datetime, keep: int = 3) -> None:
    """Write a version of a view, point to it, then delete all but the newest `keep` by time (then by turn)."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/{name}/run_id={run_id}")
    known = published(spark, f"{base}/{name}/_latest", VIEW)
    told = [(r["run_id"], r["at"], r["seq"]) for r in known if r["run_id"] != run_id]
    told = sorted([*told, (run_id, at, max([r["seq"] for r in known], default=0) + 1)], key=lambda r: r[1:])
    # the run just written is what readers get, so it stays even where its time is an early one
    last = [*[r for r in told if r[0] != run_id][max(0, len(told) - keep) :], *[r for r in told if r[0] == run_id]]
    publish(spark.createDataFrame(last, VIEW), f"{base}/{name}/_latest", keep=1)
    for old in {r[0] for r in told} - {r[0] for r in last}:
        delete(spark, f"{base}/{name}/run_id={old}")


def replace_view(df: DataFrame, base: str, name: str, run_id: str, at: datetime) -> None:
    """The rows of a new run in place of all others: readers see the old rows until the pointer turns, then the new."""
    write_view(df, base, name, run_id, at, keep=1)


def put_meta(spark: SparkSession, base: str, name: str, row: dict) -> None:
    """Append one row of run metadata, values as strings."""
    spark.createDataFrame([{k: str(v) for k, v in row.items()} | {"name": name}]).coalesce(1).write.mode("append").parquet(f"{base}/_meta")


def stable_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`df` with an id that is the SHA-256 of its fields in order of name."""
    return df.withColumn(id_col, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def import_archive(df: DataFrame, base: str, name: str, order_col: str) -> None:
    """Archive rows under stable ids, so that importing twice changes nothing."""
    upsert(stable_id(df), base, name, "doc_id", order_col)


class ProgressLog(StreamingQueryListener):
    """Rows of streaming progress: query, batch, rows in, rates, milliseconds of the trigger.

    And of rules that a stream is observed by (see with_rules): query, batch, place, rule, rows checked and broken.
    """

    def __init__(self):
        self.rows: list[dict] = []
        self.rules: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append({"query": p.name, "batch_id": p.batchId, "input_rows": p.numInputRows, "input_rps": p.inputRowsPerSecond, "processed_rps": p.processedRowsPerSecond, "duration_ms": (p.durationMs or {}).get("triggerExecution")})
        for name, told in p.observedMetrics.items():
            if name.startswith(f"{OBSERVED}:"):
                counts = told.asDict()
                checked, place = counts.pop("__n"), name.removeprefix(f"{OBSERVED}:")
                self.rules += [{"query": p.name, "batch_id": p.batchId, "place": place, "rule": rule, "checked": checked, "broken": n} for rule, n in counts.items()]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def flush(self, spark: SparkSession, base: str) -> None:
        """Append what has gathered to the tables of metrics and of rules."""
        (rows, self.rows), (rules, self.rules) = (self.rows, []), (self.rules, [])
        if rules:
            spark.createDataFrame(rules, "query string, batch_id long, place string, rule string, checked long, broken long").coalesce(1).write.mode("append").parquet(f"{base}/_rules")
        if rows:
            spark.createDataFrame(rows, "query string, batch_id long, input_rows long, input_rps double, processed_rps double, duration_ms long").coalesce(1).write.mode("append").parquet(f"{base}/_metrics")
