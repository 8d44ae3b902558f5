"""Streaming queries: plays by minute, mentions, charts, histories and recommendations.

Every job is a function of a stream; batch and stream run the same transformations. Sinks are keyed, so a
replay writes the same rows. State may lie in RocksDB: see `with_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidechart.functions.scoring import action_weight, doc_id, recency_decay
from tidechart.operators.detection import mentions
from tidechart.operators.ranking import rewrite_keys
from tidechart.operators.snapshots import latest_in_batch, mention_rows
from tidechart.plans.serving import recommend
from tidechart.shipping import ship
from tidechart.sources.lake import ViewCache
from tidechart.sources.sinks import upsert
from tidechart.streaming.history import history_rows, user_history


def with_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def once_each(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def plays_by_minute(events: DataFrame, region: str = "region", item: str = "item", exact: bool = False) -> DataFrame:
    """window, region, item, plays, skips, likes, listeners, last_ts_ms. events: ts, ts_ms, user_id, action.

    Listeners are approximate, as streams can count them, or `exact` in batches.
    """
    listeners = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    count = lambda a: F.count_if(F.col("action") == a)
    return events.groupBy(F.window("ts", "1 minute"), region, item).agg(count("play").alias("plays"), count("skip").alias("skips"), count("like").alias("likes"), listeners.alias("listeners"), F.max("ts_ms").alias("last_ts_ms"))


def plays_docs(counts: DataFrame, region: str = "region", item: str = "item") -> DataFrame:
    """Counts under the id region|item|minute."""
    minute = F.date_format("window.start", "yyyyMMddHHmm")
    return counts.select(doc_id(region, item, minute).alias("doc_id"), (F.unix_seconds("window.start") * 1000).alias("minute"), region, item, "plays", "skips", "likes", "listeners", "last_ts_ms")


def plays_per_minute(stream: DataFrame, watermark: str = "10 minutes", dedup: bool = True) -> DataFrame:
    """The stream of changed counts. Late events are dropped once the watermark has passed their minute."""
    own = once_each(stream, watermark) if dedup else stream.withWatermark("ts", watermark)
    return plays_docs(plays_by_minute(own))


def keyed_sink(stream: DataFrame, base: str, name: str, order_col: str, checkpoint: str, mode: str = "update", trigger: dict | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write a stream of documents (doc_id, ...) as keyed upserts."""

    def put(df: DataFrame, _: int) -> None:
        upsert(each(df) if each else df, base, name, "doc_id", order_col)

    return stream.writeStream.outputMode(mode).queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def mention_docs(comments: DataFrame, terms: DataFrame, title: str | None = "title") -> DataFrame:
    """doc_id comment|code, kind, weight, snippet and times of the names that comments mention.

    comments: comment_id, text, title, published_ms, crawled_ms. Made for one micro-batch of them.
    """
    found = mentions(comments, "comment_id", "text", title, terms)
    told = mention_rows(comments, "published_ms", "crawled_ms", "text").select("comment_id", "snippet", "published_ms", "crawled_ms")
    return found.join(told, "comment_id").withColumn("doc_id", doc_id("comment_id", "code"))


def stream_mentions(stream: DataFrame, terms: DataFrame, base: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    own = stream.where("comment_id IS NOT NULL AND text IS NOT NULL")
    return keyed_sink(own, base, name, "crawled_ms", checkpoint, "append", trigger, lambda df: mention_docs(df, terms))


def stream_charts(stream: DataFrame, base: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The latest snapshot of each chart. A chart's document holds all its ranks, so a shorter one leaves none behind."""

    def whole(df: DataFrame) -> DataFrame:
        last = latest_in_batch(df, ["chart_id", "chart_scope"], "crawled_ms", "rank")
        docs = last.groupBy("chart_id", "chart_scope").agg(F.max("crawled_ms").alias("crawled_ms"), F.array_sort(F.collect_list(F.struct("rank", "item", "title"))).alias("entries"))
        return docs.withColumn("doc_id", doc_id("chart_id", "chart_scope"))

    return keyed_sink(stream.where("rank IS NOT NULL AND chart_id IS NOT NULL"), base, name, "crawled_ms", checkpoint, "append", trigger, whole)


def seeds_of(rows: DataFrame, as_of_ms: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """user_id, region, item, w: decayed weight of what a user did with an item; the region is the latest."""
    place = F.max_by("region", F.struct("ts_ms", "region")).over(W.partitionBy("user_id"))
    w = action_weight(F.col("action"), weights) * recency_decay(F.col("ts_ms"), as_of_ms)
    return rows.withColumn("region", place).groupBy("user_id", "region", "item").agg(F.sum(w).alias("w"))


@dataclass
class Views:
    """Published views that recommendations read; None where one is not published.

    similar: item, neighbour, sim; trending: region, item, trend; catalog: item, title, national_score and, where
    known, artists, genre, thumbnail; alias: alias_key, canonical_key.
    """

    similar: DataFrame | None = None
    trending: DataFrame | None = None
    catalog: DataFrame | None = None
    alias: DataFrame | None = None

    @classmethod
    def of(cls, cache: ViewCache) -> Views:
        return cls(cache.get("item_sim"), cache.get("trending_batch"), cache.get("catalog"), cache.get("track_alias"))


ABOUT = {"title": "string", "artists": "array<string>", "genre": "string", "thumbnail": "string"}


def recommendation_docs(history: DataFrame, views: Views, as_of_ms: Column, size: int = 20, trend_weight: float = 0.35) -> DataFrame:
    """doc_id (user), items (rank, item, what the catalog says of it, score and its parts, reason), recent, events.

    history: what `user_history` gives for some users. Here it is cut again to events once each and to the span of the
    user's last, which changes nothing unless a batch hands a user on twice.
    Items are counted under their canonical keys. Without a ranking of a user's region the most popular items of
    the catalog stand in. A reason names the title of what was heard; `recent` has the last five events as they came.
    """
    rows = history_rows(history)
    heard = rewrite_keys(rows, views.alias, "item") if views.alias is not None else rows
    popular = views.catalog if views.catalog is not None and "national_score" in views.catalog.columns else None
    told = recommend(seeds_of(heard, as_of_ms), views.similar, views.trending, size, trend_weight, popular)
    titled = "title" in rows.columns
    names = heard.groupBy("item").agg((F.max("title") if titled else F.lit(None).cast("string")).alias("heard_title"))
    if views.catalog is not None:
        about = views.catalog.select("item", *[(F.col(c) if c in views.catalog.columns else F.lit(None).cast(t)).alias(c) for c, t in ABOUT.items()])
    else:
        about = names.select("item", F.col("heard_title").alias("title"), *[F.lit(None).cast(t).alias(c) for c, t in ABOUT.items() if c != "title"])
    known = told.join(about, "item", "left").join(names.withColumnRenamed("item", "because"), "because", "left")
    because = F.concat(F.lit("because of "), F.coalesce("heard_title", F.col("because").cast("string")))
    reason = F.when(F.col("because").isNotNull() & (F.col("cf") > 0), because).otherwise(F.lit("popular in your region"))
    parts = [F.round(c, 4).alias(c) for c in ("score", "cf", "trend")]
    items = known.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", *ABOUT, *parts, reason.alias("reason")))).alias("items"))
    seat = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts_ms"), "item", "action"))
    last = F.struct("r", "item", *(["title"] if titled else []), "action")
    recent = rows.withColumn("r", seat).groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, last))).alias("recent"), F.count("*").alias("events"), F.max("ts_ms").alias("last_ts_ms"))
    return items.join(recent, "user_id").withColumn("doc_id", F.col("user_id").cast("string"))


def stream_recommendations(stream: DataFrame, views: Callable[[], Views], as_of_ms: Callable[[], Column], base: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Recommendations by user. views: gives what is published when a batch starts, such as Views.of a ViewCache.

    Without any of the views that items come from, a batch writes nothing. Histories are kept in RocksDB, which the
    session then uses for the state of all streams that start later.
    """
    with_rocksdb(stream.sparkSession)
    ship(stream.sparkSession)

    def each(df: DataFrame) -> DataFrame:
        return recommendation_docs(df, views(), as_of_ms())

    return keyed_sink(user_history(stream), base, name, "last_ts_ms", checkpoint, "update", trigger, each)


def run_all(spark: SparkSession, seconds: int = 30, each: Callable[[], None] | None = None) -> None:
    """Wait for the first query to end, which ends the application; `each` runs in between."""
    while not spark.streams.awaitAnyTermination(seconds):
        if each:
            each()
    raise SystemExit("a streaming query stopped")
