"""Deduplication, recency, snapshots, completeness and data-quality checks.

Every order that decides between rows is total: the caller's order, then all other columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _total(df: DataFrame, keys: list[str], first: list[Column]) -> list[Column]:
    return [*first, *[F.col(c) for c in df.columns if c not in keys and not c.startswith("__") and df.schema[c].dataType.typeName() != "map"]]


def dedup(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row for each key: the first by `order`, ties by all other columns."""
    over = W.partitionBy(*keys).orderBy(*_total(df, keys, order or []))
    return df.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r")


def dedup_latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row for each key: the newest."""
    return dedup(df, keys, [F.desc(newest)])


def recent(df: DataFrame, ts: str, days: int, as_of: datetime) -> DataFrame:
    """Rows from `days` before `as_of` on."""
    return df.where(F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def event_time(ms: list[str], text: list[str]) -> Column:
    """The first of epoch-millisecond and then of text columns that gives a time; unreadable text is skipped."""
    return F.coalesce(*[F.timestamp_millis(F.col(c)) for c in ms], *[F.try_to_timestamp(F.col(c)) for c in text])


def day_window(df: DataFrame, ts: Column, days: int, as_of: datetime) -> DataFrame:
    """Rows of the `days` days up to and with the day `as_of`: [as_of + 1d - days, as_of + 1d)."""
    end = F.lit(as_of) + F.expr("INTERVAL 1 DAY")
    return df.where((ts >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (ts < end))


def latest_snapshot(df: DataFrame, by: list[str], snapshot: str) -> DataFrame:
    """All rows of each group's greatest snapshot."""
    last = df.groupBy(*by).agg(F.max(snapshot).alias(snapshot))
    return df.join(last, [*by, snapshot], "left_semi")


def latest_in_batch(df: DataFrame, by: list[str], ts: str, rank: str) -> DataFrame:
    """Rows of each group's latest time, one for each rank."""
    newest = df.withColumn("__m", F.max(ts).over(W.partitionBy(*by))).where(F.col(ts) == F.col("__m")).drop("__m")
    return dedup(newest, [*by, rank])


def latest_per_period(df: DataFrame, group: list[str], period: str, snapshot: str, ts: str) -> DataFrame:
    """The latest whole snapshot of each group and source period. Snapshots without a period stand alone."""
    times = df.groupBy(*group, period, snapshot).agg(F.max(ts).alias("__t"))
    key = F.coalesce(F.col(period), F.concat(F.lit("unknown:"), F.col(snapshot).cast("string")))
    over = W.partitionBy(*group, key).orderBy(F.desc_nulls_last("__t"), F.desc(snapshot))
    chosen = times.withColumn("__r", F.row_number().over(over)).where("__r = 1").select(*group, F.col(period).alias("__p"), snapshot)
    own = df.withColumn("__p", F.col(period))
    renamed = chosen.select(*[F.col(c).alias(f"__c_{i}") for i, c in enumerate([*group, "__p", snapshot])])
    same = [own[c].eqNullSafe(renamed[f"__c_{i}"]) for i, c in enumerate([*group, "__p", snapshot])]
    return own.join(renamed, same, "left_semi").drop("__p")


def completeness(df: DataFrame, by: list[str], item: str, rank: str, size: str) -> DataFrame:
    """by, rows, expected, is_complete: items unique, as many as the stated size, ranks exactly 1..n."""
    n = F.coalesce(F.max(size), F.max(rank), F.lit(0))
    told = df.groupBy(*by).agg(F.count("*").alias("rows"), n.alias("expected"), F.countDistinct(item).alias("__i"), F.countDistinct(rank).alias("__r"), F.min(rank).alias("__lo"), F.max(rank).alias("__hi"))
    whole = (F.col("expected") > 0) & (F.col("rows") == F.col("expected")) & (F.col("__i") == F.col("rows")) & (F.col("__r") == F.col("rows")) & (F.col("__lo") == 1) & (F.col("__hi") == F.col("expected"))
    return told.select(*by, "rows", "expected", F.coalesce(whole, F.lit(False)).alias("is_complete"))


def mention_rows(df: DataFrame, published: str, crawled: str, text: str, n: int = 300) -> DataFrame:
    """Stable time and a snippet of `n` characters."""
    return df.withColumns({"published_ms": F.coalesce(published, crawled), "snippet": F.substring(text, 1, n)})


def classify_lists(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(editorial rows, one row of counts): mirrors and rows of unknown kind are counted, not kept."""
    counts = df.agg(
        F.count_if(F.col(kind) == "editorial").alias("editorial"),
        F.count_if(F.col(kind) == "chart_mirror").alias("chart_mirror"),
        F.count_if(F.col(kind).isNull() | ~F.col(kind).isin("editorial", "chart_mirror")).alias("unknown"),
    )
    return df.where(F.col(kind) == "editorial"), counts


def validate_chart(df: DataFrame, by: list[str], item: str, rank: str, size: Column, title: str) -> DataFrame:
    """by, rows, issues: names of the checks that a snapshot fails, in fixed order, comma-joined."""
    told = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.max(size).alias("__size"), F.countDistinct(item).alias("__items"), F.count(item).alias("__named"),
        F.countDistinct(rank).alias("__ranks"), F.min(rank).alias("__lo"), F.max(rank).alias("__hi"), F.count_if(F.col(title).isNull() | (F.trim(F.col(title).cast("string")) == "")).alias("__untitled"),
    )
    checks = [
        ("unexpected_size", F.col("rows") != F.col("__size")),
        ("ranks_not_contiguous", (F.col("__lo") != 1) | (F.col("__hi") != F.col("rows")) | (F.col("__ranks") != F.col("rows"))),
        ("missing_attribution", F.col("__untitled") > 0),
        ("duplicate_ids", F.col("__items") != F.col("__named")),
    ]
    issues = F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in checks])
    return told.select(*by, "rows", issues.alias("issues"))


def input_profile(df: DataFrame, keys: list[str], item: str, group: str) -> DataFrame:
    """One row: rows, unique keys, duplicates, items, groups."""
    told = df.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*keys)).alias("unique_keys"), F.countDistinct(item).alias("items"), F.countDistinct(group).alias("groups"))
    return told.withColumn("duplicates", F.col("rows") - F.col("unique_keys"))


def _tells(rules: dict[str, Column]) -> list[Column]:
    """How many rows there are, and for how many each rule is false or null."""
    return [F.count("*").alias("__n"), *[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()]]


#: Under this name and a colon observed rules are found among the metrics of a query.
OBSERVED = "rules"


def with_rules(df: DataFrame, rules: dict[str, Column], name: str = "input") -> DataFrame:
    """`df` itself, whose rules are counted as its rows pass, in whatever is done with them: no second pass.

    Of a stream, a ProgressLog has the counts of each batch; `name` tells several places of one query apart.
    """
    return df.observe(f"{OBSERVED}:{name}", *_tells(rules))


def quality_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, checked, broken: rows for which a rule is false or null."""
    told = df.agg(*_tells(rules))
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return told.selectExpr("__n AS checked", f"stack({len(rules)}, {pairs}) AS (rule, broken)").select("rule", "checked", "broken")


def fill_profile(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """by, field, filled, rows, rate, distinct: how much of each field is filled in each group."""
    counts = [F.count(c).alias(f"n_{c}") for c in cols] + [F.countDistinct(c).alias(f"d_{c}") for c in cols]
    wide = df.groupBy(by).agg(F.count("*").alias("rows"), *counts)
    each = ", ".join(f"'{c}', n_{c}, d_{c}" for c in cols)
    long = wide.selectExpr(by, "rows", f"stack({len(cols)}, {each}) AS (field, filled, distinct_values)")
    return long.withColumn("rate", F.round(F.try_divide(F.col("filled"), F.col("rows")), 6))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """key, old_pos, new_pos, change: entered, left, moved or same. key: a column or several."""
    keys = [key] if isinstance(key, str) else key
    a, b = old.select(*keys, F.col(pos).alias("old_pos")), new.select(*keys, F.col(pos).alias("new_pos"))
    kind = F.when(F.col("old_pos").isNull(), "entered").when(F.col("new_pos").isNull(), "left").when(F.col("old_pos") != F.col("new_pos"), "moved").otherwise("same")
    return a.join(b, keys, "full_outer").withColumn("change", kind)


def counter_delta(old: DataFrame, new: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """keys, delta, seconds: how far counters moved between two snapshots."""
    a = old.select(*keys, F.col(value).alias("__v0"), F.col(ts).alias("__t0"))
    b = new.select(*keys, F.col(value).alias("__v1"), F.col(ts).alias("__t1"))
    return a.join(b, keys).select(*keys, (F.col("__v1") - F.col("__v0")).alias("delta"), (F.unix_seconds("__t1") - F.unix_seconds("__t0")).alias("seconds"))


def fingerprint(*fields: str) -> Column:
    """An identity made of fields, for records without an id of their own; nulls count as a value."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def feed_overlap(old: DataFrame, new: DataFrame, fields: list[str], ts: str, cursor: Column) -> DataFrame:
    """One row on two reads of a feed: rows of each, fingerprints that both hold, new rows behind a cursor, newest time.

    fields: what a fingerprint is made of; cursor: where the first read ended, in the units of `ts`.
    """
    a, b = (df.select(fingerprint(*fields).alias("mark")).distinct() for df in (old, new))
    both = a.join(b, "mark", "left_semi").agg(F.count("*").alias("overlap"))
    told = new.agg(F.count("*").alias("new_rows"), F.count_if(F.col(ts) > cursor).alias("after_cursor"), F.max(ts).alias("newest"))
    return old.agg(F.count("*").alias("old_rows")).crossJoin(F.broadcast(told)).crossJoin(F.broadcast(both))
