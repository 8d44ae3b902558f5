"""Bayes-smoothed shares of regions, and the best cells of a score that is built on them, without a grid of cells.

A cell's share is (x + k s) / (X + k): x of X counts of its region, s the item's share over all regions. A cell without
counts has k s / (X + k), so what is not observed follows one order of the items in every region. Tables hold observed
cells, regions and items; cells of regions and items come up only where a caller asks for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized
from tidechart.operators.ranking import top_n

#: Heads of lists are broadcast up to so many rows; beyond that Spark chooses.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Smoothed:
    """Shares of counts (region, item, value), which are not negative, with one row a cell."""

    counts: DataFrame
    region: str
    item: str
    value: str
    strength: float

    @property
    def regions(self) -> DataFrame:
        """region, total of its counts."""
        return self.counts.groupBy(self.region).agg(F.sum(self.value).alias("total"))

    @property
    def items(self) -> DataFrame:
        """item, prior: its share of all counts; the sum of all counts as 1 at least."""
        whole = self.counts.agg(F.greatest(F.coalesce(F.sum(self.value), F.lit(0)), F.lit(1)).alias("__all"))
        # one row
        return self.counts.groupBy(self.item).agg(F.sum(self.value).alias("__x")).crossJoin(F.broadcast(whole)).select(self.item, (F.col("__x") / F.col("__all")).alias("prior"))

    def share(self, x: Column, prior: Column, total: Column) -> Column:
        return (x + self.strength * prior) / (total + self.strength)

    def over(self, cells: DataFrame, out: str) -> DataFrame:
        """`cells` (region, item, ...) with value, out and out_lift, the quotient of share and prior."""
        own = cells.join(self.counts.select(self.region, self.item, self.value), [self.region, self.item], "left")
        own = own.join(self.regions, self.region, "left").join(self.items, self.item, "left").fillna(0, [self.value, "total", "prior"])
        own = own.withColumn(out, self.share(F.col(self.value), F.col("prior"), F.col("total")))
        return own.select(*cells.columns, self.value, out, F.when(F.col("prior") > 0, F.col(out) / F.col("prior")).alias(f"{out}_lift"))

    def lifts(self, out: str) -> DataFrame:
        """The counts with out and out_lift of their own cells: rows of an item meet once, totals of regions are sent."""
        whole = self.counts.agg(F.greatest(F.coalesce(F.sum(self.value), F.lit(0)), F.lit(1)).alias("__all"))
        # one row, and a row for each region
        own = self.counts.withColumn("__x", F.sum(self.value).over(W.partitionBy(self.item))).crossJoin(F.broadcast(whole)).join(F.broadcast(self.regions), self.region)
        prior = F.col("__x") / F.col("__all")
        own = own.withColumn(out, self.share(F.col(self.value), prior, F.col("total")))
        return own.select(*self.counts.columns, out, F.when(prior > 0, F.col(out) / prior).alias(f"{out}_lift"))

    def tops(self, regions: DataFrame) -> DataFrame:
        """region, total, best: the greatest share of any item, for every region of `regions`.

        That of an item without counts in the region is greatest for the greatest prior, so the observed cells and that
        one item tell it.
        """
        priors = materialized(self.items, "priors")
        most = priors.agg(F.coalesce(F.max("prior"), F.lit(0.0)).alias("__most"))
        seen = self.counts.join(priors, self.item).groupBy(self.region).agg(F.sum(self.value).alias("total"), F.max(F.col(self.value) + self.strength * F.col("prior")).alias("__seen"))
        own = regions.select(self.region).join(seen, self.region, "left").crossJoin(F.broadcast(most)).fillna(0, ["total", "__seen"])
        return own.select(self.region, "total", (F.greatest("__seen", self.strength * F.col("__most")) / (F.col("total") + self.strength)).alias("best"))


def merged_cells(region: str, item: str, **parts: tuple[DataFrame, str]) -> DataFrame:
    """region, item and a column for each part (frame, column): cells of any part, 0 where a part lacks them.

    One aggregation stands for the outer joins of all parts. Values are not negative and a part has a cell once. Rows
    are dealt by item, so what follows by item needs no other shuffle.
    """
    rows = [df.select(region, item, *[(F.col(own) if name == of else F.lit(None)).cast("double").alias(name) for name in parts]) for of, (df, own) in parts.items()]
    return reduce(DataFrame.unionByName, rows).repartition(item).groupBy(region, item).agg(*[F.coalesce(F.max(name), F.lit(0.0)).alias(name) for name in parts])


def best_cells(observed: DataFrame, regions: DataFrame, items: DataFrame, gains: list[str], score: Callable[[DataFrame], DataFrame], parts: list[str], region: str, item: str, n: int, depth: int = 256) -> DataFrame:
    """region, item, score, *parts, rank: the first n cells of each region by score, then item, of all its cells.

    observed: region, item and what is observed of a cell, not negative; if it has the gains of its items as well, they
    are not joined again. regions and items: a row for each, with what scores need of them; `gains` are the columns of items. score: adds a column score, and `parts`, to cells with all
    these columns; it does not fall as any observed or gain column rises.

    A cell that is not observed takes its place by the gains of its item alone. So items are taken from the heads of
    lists, one by each gain and one by item, `depth` of each: whatever is in none of them scores no more than the last
    places of all lists together. Where that bound reaches into a region's first n, the lists are read deeper.
    """
    seen = [c for c in observed.columns if c not in (region, item, *gains)]
    # rounded beside the score, not anew in each comparison of a sort
    order, rounded = [F.desc("__round"), F.col(item)], F.round("score", 9)
    names = [region, item, "score", *parts]
    items, regions = materialized(items, "items"), materialized(regions, "regions")
    own = observed if set(gains) <= set(observed.columns) else observed.join(items, item)
    told = score(own.join(regions, region)).select(*names)
    first = materialized(top_n(told.withColumn("__round", rounded), [region], order, n).drop("rank", "__round"), "observed")
    total, zero = items.count(), {c: F.lit(0.0) for c in seen}
    while True:
        lists = [items.orderBy(F.desc(g), item).limit(depth) for g in gains] + [items.orderBy(item).limit(depth)]
        heads = materialized(reduce(DataFrame.unionByName, lists).distinct(), "heads")
        # at most depth rows a list for each region, and one row for the bound
        sent = F.broadcast(heads) if depth * len(lists) <= BROADCAST_ROWS else heads
        listed = score(regions.crossJoin(sent).withColumns(zero)).select(*names)
        # a cell that is observed as well has its own score there, which is not below this one
        best = first.unionByName(listed).groupBy(region, item).agg(F.max(F.struct("score", *parts)).alias("__s")).select(region, item, "__s.*")
        done = materialized(top_n(best.withColumn("__round", rounded), [region], order, n).drop("__round"), "best")
        if depth >= total:
            return done
        ends = [df.agg(F.min(g).alias(g)) for g, df in zip(gains, lists)] + [lists[-1].agg(F.max(item).alias("__end"))]
        bound = score(regions.crossJoin(F.broadcast(reduce(DataFrame.crossJoin, ends))).withColumns(zero)).select(region, "__end", F.col("score").alias("__bound"))
        last = done.groupBy(region).agg(F.count("*").alias("__n"), F.max_by(F.struct("score", item), "rank").alias("__last"))
        a, b = F.round("__bound", 9), F.round("__last.score", 9)
        safe = (F.col("__n") >= n) & ((a < b) | ((a == b) & (F.col(f"__last.{item}") <= F.col("__end"))))
        if bound.join(last, region, "left").where(~F.coalesce(safe, F.lit(False))).isEmpty():
            return done
        depth *= 8
