"""Items that go together: co-occurrence in capped baskets, with a bonus for the same artist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized
from tidechart.operators.ranking import cap_group, top_n
from tidechart.operators.snapshots import dedup


def capped_baskets(baskets: DataFrame, max_basket: int = 40) -> DataFrame:
    """basket, item, w: each item once, at most `max_basket` of a basket by position; so pairs stay bounded."""
    once = dedup(baskets.repartition("basket"), ["basket", "item"], [F.col("position")])
    return cap_group(once, ["basket"], [F.col("position"), F.col("item")], max_basket).select("basket", "item", "w")


def pair_similarity(baskets: DataFrame, shrink: float = 3.0, min_support: int = 2) -> DataFrame:
    """ka < kb, sim, baskets: weight in common over the root of both weights plus `shrink`. baskets are capped."""
    n = baskets.groupBy("item").agg(F.sum("w").alias("n"))
    a = baskets.select("basket", F.col("item").alias("ka"), F.col("w"))
    b = baskets.select("basket", F.col("item").alias("kb"))
    both = a.join(b, "basket").where("ka < kb").groupBy("ka", "kb").agg(F.sum("w").alias("co"), F.count("*").alias("baskets")).where(F.col("baskets") >= min_support)
    sized = both.join(n.select(F.col("item").alias("ka"), F.col("n").alias("na")), "ka").join(n.select(F.col("item").alias("kb"), F.col("n").alias("nb")), "kb")
    return sized.select("ka", "kb", (F.col("co") / (F.sqrt(F.col("na") * F.col("nb")) + shrink)).alias("sim"), "baskets")


def _entry(neighbour: Column, sim: Column, baskets: Column) -> Column:
    """A neighbour in a list; lists are sorted by such entries."""
    return F.struct((-F.round(sim, 9)).alias("place"), neighbour.alias("neighbour"), sim.alias("sim"), baskets.alias("baskets"))


def similar_lists(baskets: DataFrame, items: DataFrame | None, max_basket: int = 40, shrink: float = 3.0, min_support: int = 2, bonus: float = 0.15, k: int = 30) -> DataFrame:
    """item, similar: the k most similar items of each in one sorted list. items: item, artist.

    All items of an artist get the bonus with one another. Pairs that only share the artist tie at the bonus and
    rank by id, below pairs that also share baskets; so an item meets just its artist's k + 1 smallest ids (one
    may be itself), and the first k are those of all pairs. Those ids come to an item as one array, not as rows.
    bonus and w are not negative.
    """
    sim = pair_similarity(materialized(capped_baskets(baskets, max_basket), "baskets"), shrink, min_support)
    order = [F.desc(F.round("sim", 9)), F.col("neighbour")]
    if items is not None:
        own = items.where(F.col("artist").isNotNull()).select("item", "artist").distinct()
        artists = own.groupBy("item").agg(F.collect_set("artist").alias("by"))
        by = lambda end: artists.select(F.col("item").alias(end), F.col("by").alias(f"by_{end}"))
        shared = F.coalesce(F.arrays_overlap("by_ka", "by_kb"), F.lit(False))
        sim = sim.join(by("ka"), "ka", "left").join(by("kb"), "kb", "left").withColumn("sim", F.col("sim") + F.when(shared, bonus).otherwise(0.0))
    each = sim.select(F.explode(F.array(F.struct(F.col("ka").alias("item"), F.col("kb").alias("neighbour")), F.struct(F.col("kb").alias("item"), F.col("ka").alias("neighbour")))).alias("p"), "sim", "baskets").select("p.*", "sim", "baskets")
    best = top_n(each, ["item"], order, k).groupBy("item").agg(F.collect_list(_entry(F.col("neighbour"), F.col("sim"), F.col("baskets"))).alias("near"))
    if items is None:
        return best.select("item", F.array_sort("near").alias("similar"))
    first = cap_group(own.withColumnRenamed("item", "neighbour"), ["artist"], [F.col("neighbour")], k + 1)
    heads = first.groupBy("artist").agg(F.collect_list("neighbour").alias("heads"))
    alone = own.join(heads, "artist").groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads"))
    # a pair that comes both ways has more than the bonus, or as much; one that is beyond the first k without `alone` stays so
    other = F.filter(F.array_except(F.col("heads"), F.coalesce(F.col("near.neighbour"), F.array().cast(alone.schema["heads"].dataType))), lambda h: h != F.col("item"))
    rest = F.transform(other, lambda h: _entry(h, F.lit(bonus), F.lit(0).cast("long")))
    whole = F.slice(F.array_sort(F.concat(F.coalesce("near", F.array().cast(best.schema["near"].dataType)), F.coalesce(rest, F.array().cast(best.schema["near"].dataType)))), 1, k)
    return best.join(alone, "item", "full_outer").select("item", whole.alias("similar")).where(F.size("similar") > 0)


def item_similarity(baskets: DataFrame, items: DataFrame | None, max_basket: int = 40, shrink: float = 3.0, min_support: int = 2, bonus: float = 0.15, k: int = 30) -> DataFrame:
    """item, neighbour, sim, baskets, rank: the lists of `similar_lists` as rows."""
    told = similar_lists(baskets, items, max_basket, shrink, min_support, bonus, k).select("item", F.posexplode("similar").alias("at", "s"))
    return told.select("item", "s.neighbour", "s.sim", "s.baskets", (F.col("at") + 1).alias("rank"))


def neighbour_docs(similar: DataFrame, items: DataFrame) -> DataFrame:
    """item, neighbours: a sorted nested list of (rank, neighbour, title, sim, baskets). items: item, title."""
    named = similar.join(items.select(F.col("item").alias("neighbour"), "title"), "neighbour", "left")
    return named.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "title", F.round("sim", 4).alias("sim"), "baskets"))).alias("neighbours"))
