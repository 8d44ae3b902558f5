"""Best cells without a grid, and names that hold names by their rarest letters, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidechart.operators import smoothing
from tidechart.operators.containment import containments
from tidechart.operators.smoothing import Smoothed, best_cells, merged_cells
from tidechart.plans import regional
from tidechart.plans.similarity import item_similarity


def grid_best(observed, regions, items, gains, score, n):
    """The first n of each region over every cell."""
    out = {}
    for r, f in regions.items():
        cells = sorted((-round(score(f, g, observed.get((r, i), 0.0)), 9), i) for i, g in items.items())
        out[r] = [(i, -s) for s, i in cells[:n]]
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "zeros"])
@pytest.mark.parametrize("depth", [1, 3, 400])
def test_best_cells_are_those_of_the_whole_grid(spark, kind, depth):
    rng = random.Random(f"{kind}{depth}")
    draw = {"spread": rng.random, "ties": lambda: rng.choice([0.0, 0.5, 1.0]), "zeros": lambda: 0.0}[kind]
    items = {i: (draw(), draw()) for i in rng.sample(range(500), 120)}
    regions = {r: (rng.random(), rng.random()) for r in "abcd"}
    observed = {(r, i): rng.choice([0.0, 0.5, 2.0]) for r in "abc" for i in rng.sample(sorted(items), 15)}
    score = lambda f, g, x: f[0] * g[0] + f[1] * g[1] + x
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = best_cells(
        frame([(r, i, x) for (r, i), x in observed.items()], "region string, item long, x double"),
        frame([(r, *f) for r, f in regions.items()], "region string, f double, g double"),
        frame([(i, *g) for i, g in items.items()], "item long, p double, q double"),
        ["p", "q"], lambda c: c.withColumn("score", F.col("f") * F.col("p") + F.col("g") * F.col("q") + F.col("x")), [], "region", "item", 7, depth,
    )
    told = {r: [] for r in regions}
    for row in sorted(got.collect(), key=lambda row: row["rank"]):
        told[row.region].append((row.item, round(row.score, 9)))
    assert told == grid_best(observed, regions, items, ["p", "q"], score, 7)


def test_few_cells_are_looked_at(spark, monkeypatch):
    sizes = []
    real = smoothing.materialized

    def counted(df, name):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(smoothing, "materialized", counted)
    items = spark.range(5000).select(F.col("id").alias("item"), (1 / (F.col("id") + 1)).alias("p"))
    regions = spark.range(40).select(F.col("id").cast("string").alias("region"), F.lit(1.0).alias("f"))
    observed = regions.select("region", F.lit(4999).cast("long").alias("item"), F.lit(0.5).alias("x"))
    got = best_cells(observed, regions, items, ["p"], lambda c: c.withColumn("score", F.col("f") * F.col("p") + F.col("x")), [], "region", "item", 3, 8)
    assert [r.item for r in got.where("region = '7'").orderBy("rank").collect()] == [0, 4999, 1]
    assert dict(sizes)["heads"] <= 16 and [n for n, _ in sizes].count("heads") == 1


def test_fewer_items_than_places_and_empty_inputs(spark):
    items = spark.createDataFrame([(1, 0.0), (2, 0.3)], "item long, p double")
    regions = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "region string, f double")
    none = spark.createDataFrame([], "region string, item long, x double")
    score = lambda c: c.withColumn("score", F.col("f") * F.col("p") + F.col("x"))
    got = best_cells(none, regions, items, ["p"], score, [], "region", "item", 5)
    assert sorted((r.region, r["rank"], r.item) for r in got.collect()) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)]
    assert best_cells(none, regions, items.limit(0), ["p"], score, [], "region", "item", 5).count() == 0
    assert best_cells(none, regions.limit(0), items, ["p"], score, [], "region", "item", 5).count() == 0


def test_greatest_shares_and_merged_cells(spark):
    counts = spark.createDataFrame([("r", "x", 9.0), ("s", "y", 1.0), ("s", "x", 0.5)], "region string, item string, v double")
    own = Smoothed(counts, "region", "item", "v", 10.0)
    regions = spark.createDataFrame([("r",), ("s",), ("t",)], "region string")
    grid = regions.crossJoin(counts.select("item").distinct())
    want = {r.region: r.best for r in own.over(grid, "share").groupBy("region").agg(F.max("share").alias("best")).collect()}
    got = {r.region: r.best for r in own.tops(regions).collect()}
    assert got == pytest.approx(want) and got["t"] == pytest.approx(9.5 / 10.5)
    assert Smoothed(counts.limit(0), "region", "item", "v", 10.0).tops(regions).select("best").distinct().collect()[0][0] == 0.0
    both = merged_cells("region", "item", v=(counts, "v"), w=(spark.createDataFrame([("r", "x", 2), ("t", "z", 3)], "region string, item string, n int"), "n"))
    assert sorted(map(tuple, both.collect())) == [("r", "x", 9.0, 2.0), ("s", "x", 0.5, 0.0), ("s", "y", 1.0, 0.0), ("t", "z", 0.0, 3.0)]


def test_estimates_follow_what_is_observed(spark):
    cell = "region string, item string, {} double"
    trend = spark.createDataFrame([("r", "x", 100.0)], cell.format("interest"))
    comments = spark.createDataFrame([("r", "x", 5.0), ("s", "y", 1.0)], cell.format("n"))
    events = spark.createDataFrame([], cell.format("n"))
    got = {(r.region, r.item): (round(r.score, 6), round(r.confidence, 6)) for r in regional.interest_estimate(trend, comments, events).collect()}
    assert got == {("r", "x"): (0.65, 0.666667), ("s", "y"): (0.03, 0.333333)}
    cells = spark.createDataFrame([("r", "x"), ("q", "z")], "region string, item string")
    assert {(r.region, r.item): r.score for r in regional.interest_estimate(trend, comments, events, cells).collect()} == {("r", "x"): pytest.approx(0.65), ("q", "z"): 0.0}


def test_containments_against_all_pairs(spark):
    rng = random.Random(1)
    names = [(rng.choice("uvw"), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for _ in range(250)]
    names += [("u", "the long name of a band"), ("u", "name of"), ("u", "aaaaaaa"), ("u", "aaaa"), ("v", None)]
    got = {tuple(r) for r in containments(spark.createDataFrame(names, "b string, n string"), "b", "n").select("b", "holder", "held").collect()}
    kept = [(b, n) for b, n in names if n and len(n) >= 3]
    assert got == {(b, x, y) for b, x in kept for c, y in kept if b == c and y in x}


def test_names_without_a_common_run_do_not_meet(spark):
    """A block of unlike names is found apart without pairs of them."""
    names = spark.range(3000).select(F.lit("b").alias("b"), F.md5(F.col("id").cast("string")).alias("n"))
    met = containments(names, "b", "n")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() == 3000 and "run#" in plan.split("Join")[1], "the join is by runs of letters"


def test_similarity_with_shared_artists(spark):
    baskets = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, 1.0), ("b", 1, 1, 1.0), ("b", 2, 2, 1.0), ("b", 3, 3, 1.0), ("a", 3, 3, 1.0)], "basket string, item long, position long, w double")
    items = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x"), (3, "y"), (4, "z"), (4, "x"), (5, None), (6, "y")], "item long, artist string")
    got = {(r.item, r.neighbour): (round(r.sim, 6), r.baskets) for r in item_similarity(baskets, items).collect()}
    assert got == {
        (1, 2): (0.55, 2), (2, 1): (0.55, 2), (1, 3): (0.4, 2), (3, 1): (0.4, 2), (2, 3): (0.4, 2), (3, 2): (0.4, 2),
        (1, 4): (0.15, 0), (4, 1): (0.15, 0), (2, 4): (0.15, 0), (4, 2): (0.15, 0), (3, 6): (0.15, 0), (6, 3): (0.15, 0),
    }
    assert len(item_similarity(baskets, None).collect()) == 6
