"""Query-time answers over batch and live views. Times are arguments, so a result can be told again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.functions.text import norm_text
from tidechart.operators.ranking import over_best, ranked, top_n

PARTS = ("national", "trends", "mentions", "events")


def merge_trending(batch: DataFrame, plays: DataFrame, mentions: DataFrame, mode: str = "merged", weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """region, item, score, rank, batch_rank, rank_change and the parts of the score.

    batch: region, item, rank, score, c_national, c_trends, c_mentions, c_events; plays: region, item, plays,
    likes of the last minutes; mentions: region, item, mentions of the last days. Each side counts relative
    to its best in the region. Only positive scores are ranked. Modes: batch, realtime, merged.
    """
    a = over_best(batch, "score", ["region"], "batch").select("region", "item", F.col("rank").alias("batch_rank"), "batch", *[F.coalesce(F.try_divide(F.col(f"c_{p}"), F.col("score")), F.lit(0.0)).alias(f"s_{p}") for p in PARTS])
    p = over_best(plays.withColumn("load", F.col("plays") + 2 * F.col("likes")), "load", ["region"], "live").select("region", "item", "live")
    m = over_best(mentions, "mentions", ["region"], "said").select("region", "item", "said")
    own = a.join(p, ["region", "item"], "full_outer").join(m, ["region", "item"], "full_outer").fillna(0.0, ["batch", "live", "said", *[f"s_{x}" for x in PARTS]])
    w = {"batch": (1.0, 0.0, 0.0), "realtime": (0.0, 0.8, 0.2), "merged": weights}[mode]
    part = {x: w[0] * F.col("batch") * F.col(f"s_{x}") for x in PARTS}
    part["mentions"] = part["mentions"] + w[2] * F.col("said")
    part["events"] = part["events"] + w[1] * F.col("live")
    scored = own.withColumns({f"p_{x}": part[x] for x in PARTS}).withColumn("score", sum(F.col(f"p_{x}") for x in PARTS)).where("score > 0")
    # rounded once, not in each comparison of a sort
    placed = ranked(scored.withColumn("__round", F.round("score", 9)), ["region"], [F.desc("__round"), F.col("item")])
    return placed.select("region", "item", "score", "rank", "batch_rank", (F.col("batch_rank") - F.col("rank")).alias("rank_change"), *[f"p_{x}" for x in PARTS])


def realtime_totals(plays: DataFrame, mentions: DataFrame, since: Column, mentions_since: Column) -> DataFrame:
    """region, plays, likes since a time, and mentions and authors since another. plays: region, ts, plays, likes."""
    a = plays.where(F.col("ts") >= since).groupBy("region").agg(F.sum("plays").alias("plays"), F.sum("likes").alias("likes"))
    b = mentions.where(F.col("ts") >= mentions_since).groupBy("region").agg(F.round(F.sum("weight"), 1).alias("mentions"), F.countDistinct("author").alias("authors"))
    return a.join(b, "region", "full_outer")


def region_overview(dim: DataFrame, profile: DataFrame, live: DataFrame) -> DataFrame:
    """Every region with its profile and live totals; numbers that are missing are 0."""
    return dim.join(profile, "region", "left").join(live, "region", "left").fillna(0)


def latest_rows(df: DataFrame, where: Column, newest: list[Column], n: int) -> DataFrame:
    return df.where(where).orderBy(*newest).limit(n)


def ranking(catalog: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n entries of greatest positive score."""
    return catalog.where(F.col(score) > 0).orderBy(F.desc(F.round(score, 9)), key).limit(n)


def chart_list(charts: DataFrame) -> DataFrame:
    """chart_id, source, entries, last_snapshot."""
    return charts.groupBy("chart_id", "source").agg(F.count("*").alias("entries"), F.max("snapshot_id").alias("last_snapshot"))


def lookup(view: DataFrame, **filters: object) -> DataFrame:
    """Rows of a view by equality; None means no filter."""
    for name, value in filters.items():
        if value is not None:
            view = view.where(F.col(name) == value)
    return view


def timeline(listens: DataFrame, unit: str = "minute") -> DataFrame:
    """at, plays, skips, likes, users by time unit."""
    count = lambda a: F.count_if(F.col("action") == a)
    return listens.groupBy(F.date_trunc(unit, "ts").alias("at")).agg(count("play").alias("plays"), count("skip").alias("skips"), count("like").alias("likes"), F.countDistinct("user_id").alias("users"))


def search(catalog: DataFrame, q: str, text: str, score: str, key: str, n: int = 20) -> DataFrame:
    """Entries whose normalised text holds the query, most popular first."""
    found = catalog.where(F.contains(F.col(text), norm_text(F.lit(q))))
    return found.orderBy(F.desc_nulls_last(score), key).limit(n)


def cold_start(users: DataFrame, known: DataFrame, trending: DataFrame, n: int = 20) -> DataFrame:
    """user_id, item, rank: for users without a list of their own, what trends in their region."""
    new = users.join(known.select("user_id"), "user_id", "left_anti")
    return new.join(trending.select("region", "item", "score"), "region").transform(lambda d: top_n(d, ["user_id"], [F.desc(F.round("score", 9)), F.col("item")], n))


def kpis(charts: DataFrame, listens: DataFrame, items: DataFrame) -> DataFrame:
    """source, records, snapshots, last_snapshot for each source, with totals of listens and items beside."""
    told = charts.groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("snapshot_id").alias("snapshots"), F.max("snapshot_id").alias("last_snapshot"))
    return told.crossJoin(F.broadcast(listens.agg(F.count("*").alias("listens")))).crossJoin(F.broadcast(items.agg(F.count("*").alias("items"))))


def system_kpis(totals: dict[str, DataFrame], evidence: DataFrame, trends: DataFrame, sources: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One document of what a run has covered: totals by name, regions by confidence, trends, sources, weights.

    totals: relations whose rows are counted, under the name of the figure; evidence: region, confidence_label,
    self_mentions; trends: item, seen; sources: source, records, snapshots, last_snapshot. Trends are a source too.
    """
    by_label = evidence.agg(F.count_if(F.col("confidence_label") == "high").alias("regions_high_confidence"), F.count_if(F.col("confidence_label") == "medium").alias("regions_medium_confidence"), F.coalesce(F.sum("self_mentions"), F.lit(0)).alias("self_mentions"))
    observed = trends.agg(F.count("*").alias("trend_records"), F.countDistinct("item").alias("trend_items"), F.max("seen").alias("last"))
    as_source = observed.where("trend_records > 0").select(F.lit("trends").alias("source"), F.col("trend_records").alias("records"), F.col("trend_items").alias("snapshots"), F.col("last").cast("string").alias("last_snapshot"))
    listed = sources.select("source", "records", "snapshots", F.col("last_snapshot").cast("string").alias("last_snapshot")).unionByName(as_source)
    by_source = listed.agg(F.array_sort(F.collect_list(F.struct("source", "records", "snapshots", "last_snapshot"))).alias("sources"))
    out = by_label.crossJoin(F.broadcast(observed.drop("last"))).crossJoin(F.broadcast(by_source))
    for name, rows in totals.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return out.withColumn("weights", F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]))


def recommend(seeds: DataFrame, similar: DataFrame | None, trending: DataFrame | None, n: int = 20, trend_weight: float = 0.35, popular: DataFrame | None = None, most_popular: int = 50, parts: int | None = None) -> DataFrame:
    """user_id, region, item, score, cf, trend, because, rank.

    seeds: user_id, region, item, w (decayed weight of what a user did); similar: item, neighbour, sim;
    trending: region, item, trend (0 to 1). Items already heard do not come back. Users of a region without trending items (all users, if
    there is no such view) get the `most_popular` first of `popular` (item, national_score) in their place.

    What tells of a user comes to one place as lists, one for each seed, and is opened there: candidates of all seeds are
    never written. parts: into how many parts users are dealt; it should grow with the seeds.
    """
    kind = seeds.schema["item"].dataType
    users = seeds.select("user_id", "region").distinct()
    listed = lambda item, value: F.collect_list(F.struct(F.col(item).alias("cand"), F.col(value).cast("double").alias("x")))
    row = lambda df, what, item, w: df.select("user_id", "region", F.lit(what).alias("what"), item.cast(kind).alias("item"), w.cast("double").alias("w"), F.col("l.cand").alias("cands"), F.col("l.x").alias("xs"))
    none = F.lit(None)
    # a seed in one region of a user counts as heard in all
    heard = seeds.select("user_id", "item").join(users, "user_id").withColumn("l", F.array(F.struct(F.col("item").alias("cand"), F.lit(0.0).alias("x"))))
    told = row(heard, "heard", none, none)
    if similar is not None:
        lists = similar.groupBy("item").agg(listed("neighbour", "sim").alias("l"))
        told = told.unionByName(row(seeds.where("w > 0").join(lists, "item"), "like", F.col("item"), F.col("w")))
    if trending is not None:
        told = told.unionByName(row(users.join(trending.groupBy("region").agg(listed("item", "trend").alias("l")), "region"), "hot", none, none))
    if popular is not None:
        top = popular.orderBy(F.desc("national_score"), "item").limit(most_popular).agg(listed("item", "national_score").alias("l"))
        without = users if trending is None else users.join(trending.select("region").distinct(), "region", "left_anti")
        # one list of fifty, for users that have no other
        told = told.unionByName(row(without.crossJoin(F.broadcast(top)), "hot", none, none))
    own = told.repartition(parts, "user_id") if parts else told.repartition("user_id")
    opened = own.select("user_id", "region", "what", "item", "w", F.explode(F.arrays_zip("cands", "xs")).alias("c")).select("user_id", "region", "what", "item", F.col("c.cands").alias("cand"), F.col("c.xs").alias("x"), (F.col("w") * F.col("c.xs")).alias("gain"))
    is_ = lambda what: F.col("what") == what
    both = opened.groupBy("user_id", "region", "cand").agg(
        F.sum("gain").alias("cf"), F.max(F.when(is_("hot"), F.col("x"))).alias("trend"), F.max_by("item", F.when(is_("like"), F.struct("gain", "item"))).alias("because"),
        F.max(is_("heard")).alias("heard"),
    )
    both = both.withColumn("cf", F.try_divide(F.col("cf"), F.max("cf").over(W.partitionBy("user_id")))).fillna(0.0, ["cf", "trend"])
    fresh = both.where("NOT heard")
    scored = fresh.select("user_id", "region", F.col("cand").alias("item"), (F.col("cf") + trend_weight * F.col("trend")).alias("score"), "cf", "trend", "because")
    return top_n(scored, ["user_id"], [F.desc(F.round("score", 9)), F.col("item")], n)
