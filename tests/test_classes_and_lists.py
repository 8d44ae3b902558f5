"""Copies told by classes, neighbours and runs kept as lists of bounded parts, exact listeners."""

import random

import duckdb
from pyspark.sql import functions as F

from tidechart.plans import resolution, search_index, serving, similarity
from tidechart.queries import ORACLES, QUERIES
from tidechart.streaming.jobs import plays_by_minute


def test_listeners_are_exact(spark):
    own = spark.range(3000).select(F.lit("2024-01-01 00:00:10").cast("timestamp").alias("ts"), F.lit(1).alias("ts_ms"), (F.col("id") % 2000).alias("user_id"), F.lit("play").alias("action"), F.lit("r").alias("region"), F.lit("k").alias("item"))
    assert [r.listeners for r in plays_by_minute(own, exact=True).collect()] == [2000]


def test_copies_are_members_and_names_pairs(spark):
    own = spark.createDataFrame([("t", i, "Son Tung") for i in range(1, 301)] + [("t", 500, "son tung mtp"), ("t", 501, "other"), ("u", 502, "son tung"), ("t", 503, "ab")], "block string, item long, artist string")
    got = resolution.overlap_pairs(own, "block", "item", "artist").collect()
    assert len(got) == 304
    assert sorted((r.block, r.a, r.b) for r in got if r.kind == "pair") == [("t", 1, 500)]
    assert {r.b: r.a for r in got if r.kind == "member"} == {**{i: 1 for i in range(1, 301)}, 500: 500, 501: 501, 502: 502}


def test_lists_of_similar_items(spark):
    rng = random.Random(5)
    artist = {i: rng.choice("xyz") for i in range(40)}
    baskets = spark.createDataFrame([(f"b{b}", i, at, 1.0) for b in range(30) for at, i in enumerate(rng.sample(range(40), 5))], "basket string, item long, position long, w double")
    items = spark.createDataFrame([(i, a) for i, a in artist.items()] + [(3, "w"), (4, "w")], "item long, artist string")
    by = {i: {a, "w"} if i in (3, 4) else {a} for i, a in artist.items()}
    sims = {(r.ka, r.kb): r.sim for r in similarity.pair_similarity(similarity.capped_baskets(baskets)).collect()}
    want = {}
    for i in range(40):
        told = []
        for j in range(40):
            s = sims.get((min(i, j), max(i, j)), 0.0) + (0.15 if by[i] & by[j] else 0.0)
            if i != j and s > 0:
                told.append((-round(s, 9), j))
        want[i] = [j for _, j in sorted(told)[:7]]
    lists = similarity.similar_lists(baskets, items, k=7)
    assert {r["item"]: [s.neighbour for s in r.similar] for r in lists.collect()} == want


def test_candidates_are_opened_where_their_user_is(spark):
    seeds = spark.createDataFrame([("u", "r", 1, 2.0), ("u", "s", 2, 1.0), ("v", "r", 3, -1.0)], "user_id string, region string, item long, w double")
    sim = spark.createDataFrame([(1, 2, 0.9), (1, 4, 0.5), (2, 4, 0.5), (2, 5, 0.1)], "item long, neighbour long, sim double")
    hot = spark.createDataFrame([("r", 6, 1.0), ("r", 3, 0.5)], "region string, item long, trend double")
    out = serving.recommend(seeds, sim, hot, parts=3)
    got = {(r.user_id, r.region, r["item"]): (round(r.cf, 6), r.trend, r.because) for r in out.collect()}
    # 2 is heard in another region, and is the best of the user all the same
    assert got == {("u", "r", 4): (round(1.0 / 1.8, 6), 0.0, 1), ("u", "s", 4): (round(0.5 / 1.8, 6), 0.0, 2), ("u", "s", 5): (round(0.1 / 1.8, 6), 0.0, 2), ("u", "r", 6): (0.0, 1.0, None), ("u", "r", 3): (0.0, 0.5, None), ("v", "r", 6): (0.0, 1.0, None)}
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    opened = next(i for i, x in enumerate(lines) if "Generate explode(arrays_zip" in x)
    assert not any("Exchange" in x for x in lines[:opened])


def test_runs_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(search_index, "ENTRIES", 100)
    own = spark.range(1000).select("id", F.concat(F.lit("song "), F.col("id")).alias("text")).coalesce(1)
    runs = search_index.letter_runs(own, "text", "id")
    assert runs.rdd.getNumPartitions() == 10
    assert runs.where("run = 'son'").count() == 1000 and runs.count() == runs.distinct().count()


def meeting(rows):
    """(block, a, b) of each two of the rows (block, key, compact name) that meet, compared one by one."""
    named = [r for r in rows if None not in r and len(r[2]) >= 3]
    return sorted((b, min(j, k), max(j, k)) for n, (b, j, x) in enumerate(named) for c, k, y in named[:n] if b == c and j != k and (x in y or y in x))


def test_pairs_of_keys_are_whole(spark, monkeypatch):
    monkeypatch.setattr(resolution, "KEYS_A_LIST", 4)
    monkeypatch.setattr(resolution, "PAIRS_A_TASK", 50)
    monkeypatch.setattr(resolution, "LISTS_A_TASK", 3)
    rng = random.Random(7)
    names = {"Sơn Tùng": "sontung", "son tung": "sontung", "Son Tung M-TP": "sontungmtp", "Tung": "tung", "ab": "ab", "other": "other", None: None}
    rows = [(rng.choice("tuv"), rng.randrange(60), rng.choice(list(names))) for _ in range(150)]
    # a row twice, a key with two names, nulls
    rows += [("t", 7, "Tung"), ("t", 7, "Tung"), ("t", 7, "son tung"), ("t", None, "Tung"), (None, 8, "Tung"), (None, 9, "Tung")]
    own = spark.createDataFrame(rows, "block string, item long, artist string")
    got = sorted(tuple(r) for r in resolution.key_pairs(own, "block", "item", "artist").collect())
    want = meeting([(b, k, names[n]) for b, k, n in rows])
    assert len(want) > 500 and got == want


def test_overlap_pairs_writes_out_equal_names(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").collect()
    want = meeting([(p.p_name, p.p_partkey, p.p_brand.lower().replace("#", "")) for p in part])
    own = QUERIES["overlap_pairs"](spark, small)
    assert own.columns == ["block", "a", "b"]
    got = sorted(tuple(r) for r in own.collect())
    assert got == want
    brand = {p.p_partkey: p.p_brand for p in part}
    assert any(brand[a] == brand[b] for _, a, b in got) and any(brand[a] != brand[b] for _, a, b in got)


def test_overlap_pairs_of_repeated_parts(spark, tmp_path):
    rows = [(1, "red", "Brand#1"), (1, "red", "Brand#1"), (2, "red", "Brand#1"), (3, "red", "Brand#11"), (3, "blue", "Brand#2"), (4, "blue", "Brand#2"), (5, "red", None), (6, None, "Brand#1"), (None, "red", "Brand#1"), (7, "red", "#1"), (8, "blue", "brând 2")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").selectExpr("*", "'t' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["overlap_pairs"]).fetchall())
    assert len(want) > 10 and sorted(tuple(r) for r in QUERIES["overlap_pairs"](spark, str(tmp_path)).collect()) == want


def test_long_classes_are_opened_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolution, "PAIRS_A_TASK", 100_000)
    own = spark.range(2000).select(F.lit("t").alias("block"), F.col("id").alias("item"), F.lit("Son Tung").alias("artist"))
    out = resolution.key_pairs(own, "block", "item", "artist")
    a_task = [len(x) for x in out.select("a").rdd.glom().collect()]
    assert sum(a_task) == 2000 * 1999 // 2 and len(a_task) > 20 and max(a_task) < 300_000
