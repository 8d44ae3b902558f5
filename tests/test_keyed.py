"""Keyed tables by deltas: what is written follows what comes in; crashes, readers, merges, null ids."""

import random

import pytest
from pyspark.sql import functions as F

from tidechart.functions.scoring import doc_id
from tidechart.sources import keyed

SCHEMA = "id string, v long, at long"


def put(spark, base, rows, **more):
    keyed.upsert(spark.createDataFrame(rows, SCHEMA), base, "t", "id", "at", **{"buckets": 2, **more})


def told(spark, base):
    return sorted(tuple(r) for r in keyed.read_upserted(spark, base, "t").select("id", "v", "at").collect())


def manifest(spark, base):
    return keyed.published(spark, f"{base}/t/_manifest", keyed.TABLE)


def files(path):
    return {p: p.stat().st_size for p in path.rglob("*.parquet") if "_manifest" not in str(p)}


def test_random_writes_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    for _ in range(14):
        rows = [(f"k{rng.randrange(12)}", rng.randrange(100), rng.choice([None, 1, 2, 3])) for _ in range(rng.randrange(1, 6))]
        rows = list({r[0]: r for r in rows}.values())
        put(spark, str(tmp_path), rows, run=rng.choice([1, 2, 3]), bucket_bytes=rng.choice([1 << 20, 5000]))
        for r in rows:
            if r[0] not in want or (r[2] or 0) >= (want[r[0]][2] or 0):
                want[r[0]] = r
        assert told(spark, str(tmp_path)) == sorted(want.values())


def test_a_write_writes_what_came_in(spark, tmp_path):
    base = str(tmp_path)
    keyed.upsert(spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.rand(1).alias("v"), F.lit(1).alias("at")), base, "t", "id", "at", 2)
    before = files(tmp_path)
    for k in range(3):
        keyed.upsert(spark.createDataFrame([(str(k), 0.5, 2)], "id string, v double, at int"), base, "t", "id", "at", 2)
    new = {p: n for p, n in files(tmp_path).items() if p not in before}
    assert set(before) <= set(files(tmp_path)) and sum(new.values()) * 100 < sum(before.values())
    got = keyed.read_upserted(spark, base, "t")
    assert got.count() == 200_000 and got.where("at = 2").count() == 3


def test_files_of_a_bucket_stay_few(spark, tmp_path):
    base, most = str(tmp_path), 0
    for k in range(24):
        put(spark, base, [(f"k{k}", k, k)], buckets=1, run=3)
        most = max(most, sum(r["live"] for r in manifest(spark, base)))
    assert most <= 5 and len(told(spark, base)) == 24
    assert len(files(tmp_path)) <= 2 * most, "what was replaced is deleted by the write after"


def test_merges_go_back_as_far_as_files_are_alike():
    row = lambda turn, n: {"turn": turn, "bytes": n}
    turns = lambda files, limit: [r["turn"] for r in keyed._run(files, limit)]
    assert turns([row(1, 9), row(2, 9)], 2) == []
    assert turns([row(1, 1000), row(2, 10), row(3, 10), row(4, 10)], 3) == [4, 3, 2]
    assert turns([row(1, 50), row(2, 10), row(3, 10), row(4, 10)], 3) == [4, 3, 2, 1]
    assert turns([row(1, 50), row(2, 4000), row(3, 10), row(4, 10)], 3) == [4, 3]


def test_a_null_id_is_an_error_and_nothing_is_written(spark, tmp_path):
    base = str(tmp_path)
    put(spark, base, [("a", 1, 1)])
    with pytest.raises(Exception, match="has no id"):
        put(spark, base, [("b", 1, 1), (None, 2, 1)])
    assert told(spark, base) == [("a", 1, 1)]
    raw = spark.createDataFrame([("t", None, 5), ("t", 0, None), ("t", 0, 5)], "topic string, partition int, offset long")
    assert sorted(str(r[0]) for r in raw.select(keyed.record_id()).collect()) == ["None", "None", "t:0:5"]
    parts = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None)], "x string, y string")
    assert len({r[0] for r in parts.select(doc_id("x", "y")).collect()}) == 4


@pytest.mark.parametrize("step", ["put", "merge", "publish"])
def test_a_crash_leaves_the_table_of_before(spark, tmp_path, monkeypatch, step):
    base = str(tmp_path)
    for k in range(3):
        put(spark, base, [("a", k, k), ("b", k, k)], buckets=1, run=3)
    with monkeypatch.context() as m:

        def fail(*args, **k):
            raise RuntimeError("lost")

        real, calls = keyed._put, []
        if step == "publish":
            m.setattr(keyed, "publish", fail)
        else:  # the files of the first or of the second write are there
            m.setattr(keyed, "_put", lambda *a: (calls.append(1), real(*a), fail() if len(calls) == (1 if step == "put" else 2) else None)[1])
        with pytest.raises(RuntimeError):
            put(spark, base, [("a", 9, 9), ("c", 9, 9)], buckets=1, run=3)
    assert told(spark, base) == [("a", 2, 2), ("b", 2, 2)]
    put(spark, base, [("a", 9, 9), ("c", 9, 9)], buckets=1, run=3)
    put(spark, base, [("d", 1, 1)], buckets=1, run=3)
    assert told(spark, base) == [("a", 9, 9), ("b", 2, 2), ("c", 9, 9), ("d", 1, 1)]
    known = {r["path"] for r in manifest(spark, base)}
    assert {str(p.parent) for p in files(tmp_path)} == known, "what the crash left is gone"


def test_readers_keep_their_files_and_columns_come_and_go(spark, tmp_path):
    base = str(tmp_path)
    put(spark, base, [("a", 1, 1), ("b", 1, 1)])
    reader = keyed.read_upserted(spark, base, "t")
    keyed.upsert(spark.createDataFrame([("a", "x", 2)], "id string, more string, at long"), base, "t", "id", "at", 2, bucket_bytes=1)
    assert reader.count() == 2
    assert sorted((r.id, r.v, r.more) for r in keyed.read_upserted(spark, base, "t").collect()) == [("a", None, "x"), ("b", 1, None)]
    put(spark, base, [])
    assert len(told(spark, base)) == 2
    with pytest.raises(ValueError):
        keyed.upsert(spark.createDataFrame([("a", 1, 1)], SCHEMA), base, "t", "v", "at", 2)


def test_one_write_of_many_rows_of_one_id(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("v"), (F.col("id") % 1000).alias("at"))
    keyed.upsert(rows, str(tmp_path), "t", "id", "at")
    got = {r[0]: r for r in told(spark, str(tmp_path))}
    assert len(got) == 3334 and got["hot"][2] == 999
