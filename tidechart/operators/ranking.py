"""Building blocks of scores: tops, shares, rank correlation, smoothing, set overlap, lagged joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized

#: Rows that one task ranks.
RANK_ROWS = 100_000


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", size: str | None = None, rows: int | None = None) -> DataFrame:
    """`df` with the place of each row in its group by a total order, and the group's number of rows, where groups are few and long.

    Rows are dealt to ranges of group and order, so no task holds a group; the counts of ranges tell where each begins.
    A range is sorted and numbered as it is written, so rows are sent once.
    """
    own = materialized(df, "unranked")
    # one task's rows in a range
    parts = max(1, -(-own.count() // (rows or RANK_ROWS)))
    places = [F.col(c) for c in by] + order
    # numbers rise by one within a range, from its own number in the upper 31 bits
    sorted_ = own.repartitionByRange(parts, *places).sortWithinPartitions(*places).withColumn("__row", F.monotonically_increasing_id())
    dealt = materialized(sorted_.withColumn("__part", F.shiftright("__row", 33)), "ranges")
    sizes = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), before.alias("__before"), "__first", F.sum("__n").over(group).alias("__size"))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    # a row for each range of a group
    out = dealt.join(F.broadcast(told), same).withColumn(rank, (F.col("__before") + F.col("__row") - F.col("__first") + 1).cast("int"))
    return out.select(*df.columns, rank, *([F.col("__size").cast("int").alias(size)] if size else []))


def over_best(df: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """`df` with a column over its group's maximum; null where that is 0. Groups are few: their maxima are sent, no group is one task."""
    best = df.groupBy(*by).agg(F.max(col).alias("__best")).select(*[F.col(c).alias(f"__by_{c}") for c in by], "__best")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(F.broadcast(best), same).select(*df.columns, F.try_divide(F.col(col), F.col("__best")).alias(out))


def norm_by_max(col: str, by: list[str], floor: float | None = None) -> Column:
    """A column over its group's maximum; null where that is 0, unless `floor` bounds it."""
    top = F.max(col).over(W.partitionBy(*by))
    return F.try_divide(F.col(col), F.greatest(top, F.lit(floor)) if floor is not None else top)


def share_of(col: str, by: list[str]) -> Column:
    """A column over its group's sum; the sum counts as 1 at least."""
    return F.col(col) / F.greatest(F.sum(col).over(W.partitionBy(*by)), F.lit(1))


def best_then_sum(df: DataFrame, item: str, source: str, points: str) -> DataFrame:
    """item, points: each source counts with its best, sources add up."""
    best = df.groupBy(item, source).agg(F.max(points).alias(points))
    return best.groupBy(item).agg(F.sum(points).alias(points))


def weighted_rollup(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """The weighted mean of `value` over a coarser grouping."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(out))


def skip_rate(action: str = "action") -> Column:
    """Skips among plays and skips; null without either."""
    skips, plays = F.count_if(F.col(action) == "skip"), F.count_if(F.col(action) == "play")
    return F.try_divide(skips, plays + skips)


def with_global(df: DataFrame, agg: Column, name: str) -> DataFrame:
    """`df` with a global aggregate as a column: one row, cross-joined; nothing passes through the driver."""
    return df.crossJoin(F.broadcast(df.agg(agg.alias(name))))


def spearman(df: DataFrame, by: list[str], a: list[Column], b: list[Column], min_n: int) -> DataFrame:
    """by, n, rho: rank correlation of two total orders within a group; null under `min_n` rows."""
    over = W.partitionBy(*by)
    ranks = df.select(*by, F.row_number().over(over.orderBy(*a)).alias("__a"), F.row_number().over(over.orderBy(*b)).alias("__b"))
    told = ranks.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("__a") - F.col("__b"), 2)).alias("__d2"))
    rho = 1 - F.try_divide(6 * F.col("__d2"), F.col("n") * (F.pow("n", F.lit(2)) - 1))
    return told.select(*by, "n", F.when(F.col("n") >= min_n, rho).alias("rho"))


def key_universe(key: str, *dfs: DataFrame) -> DataFrame:
    """All distinct keys of several frames."""
    out = dfs[0].select(key)
    for df in dfs[1:]:
        out = out.unionByName(df.select(key))
    return out.distinct()


def universe(regions: DataFrame, items: DataFrame) -> DataFrame:
    """Every region with every item. Regions are a dimension; the plan shows which side is sent."""
    return regions.crossJoin(items)


def jaccard_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, common, jaccard: overlap of item sets for pairs of groups that share an item.

    Pairs come from a join on the item, so groups must be few or items rarely shared by many of them.
    """
    own = df.select(group, item).distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("n"))
    left, right = own.select(F.col(group).alias("a"), item), own.select(F.col(group).alias("b"), item)
    common = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    sized = common.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("n_b")), "b")
    return sized.select("a", "b", "common", "n_a", "n_b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


def lag_join(df: DataFrame, by: list[str], date: str, lags: tuple[int, ...], carry: list[str]) -> DataFrame:
    """Rows joined with those of the same group `lag` days later; carried columns get _before and _after."""
    lag = F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag_days")
    first = df.select(*by, date, *[F.col(c).alias(f"{c}_before") for c in carry], lag).withColumn("__d", F.date_add(F.col(date).cast("date"), F.col("lag_days")))
    later = df.select(*by, F.col(date).cast("date").alias("__d"), *[F.col(c).alias(f"{c}_after") for c in carry])
    return first.join(later, [*by, "__d"]).drop("__d")


def rewrite_keys(df: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    """`key` replaced by its canonical key. alias: alias_key, canonical_key; Spark chooses how to join."""
    named = alias.select(F.col("alias_key").alias(key), "canonical_key")
    return df.join(named, key, "left").withColumn(key, F.coalesce("canonical_key", key)).drop("canonical_key").select(*df.columns)


def cap_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group, the first by a total order."""
    return top_n(df, by, order, k, "__rank").drop("__rank")
