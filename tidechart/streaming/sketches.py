"""Listeners over any span from rows by minute: each minute keeps a sketch of its users, spans unite them.

Counts of users do not add up, since the same user comes back; sketches do. A row has 2^LG registers at most, so a minute
costs the same however many listen, and an estimate's relative error is 1.04 / sqrt(2^LG), some 1.6 % at 12; few users
are counted exactly. Events without a user add none. Late events change their own minute only, within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidechart.functions.scoring import doc_id
from tidechart.streaming.jobs import keyed_sink, once_each

LG = 12
COUNTS = ("plays", "skips", "likes")


def minute_sketches(events: DataFrame, by: tuple[str, ...] = ("region", "item"), lg: int = LG) -> DataFrame:
    """doc_id, minute, the columns of `by`, plays, skips, likes, users (a sketch), last_ts_ms. events: ts, ts_ms, user_id, action."""
    count = lambda a: F.count_if(F.col("action") == a)
    told = events.groupBy(F.window("ts", "1 minute"), *by).agg(count("play").alias("plays"), count("skip").alias("skips"), count("like").alias("likes"), F.hll_sketch_agg("user_id", lg).alias("users"), F.max("ts_ms").alias("last_ts_ms"))
    name = doc_id(*by, F.date_format("window.start", "yyyyMMddHHmm"))
    return told.select(name.alias("doc_id"), F.col("window.start").alias("minute"), *by, *COUNTS, "users", "last_ts_ms")


def stream_minute_sketches(stream: DataFrame, base: str, name: str, checkpoint: str, trigger: dict | None = None, watermark: str = "10 minutes") -> StreamingQuery:
    """Keep the rows by minute in a keyed table, each event counted once within the watermark."""
    return keyed_sink(minute_sketches(once_each(stream, watermark)), base, name, "last_ts_ms", checkpoint, "update", trigger)


def rolled_up(minutes: DataFrame, unit: str = "hour", by: tuple[str, ...] = ("region", "item")) -> DataFrame:
    """at, the columns of `by`, plays, skips, likes, listeners (estimated): rows by minute over a longer unit.

    No event is read again. `by` may leave out columns of the minutes, whose users are then united too.
    """
    users = F.hll_sketch_estimate(F.hll_union_agg("users"))
    return minutes.groupBy(F.date_trunc(unit, "minute").alias("at"), *by).agg(*[F.sum(c).alias(c) for c in COUNTS], users.alias("listeners"))
