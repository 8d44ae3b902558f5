"""Histories in state against the batch query: any order, restarts, late rows, idle users."""

import random

import pytest
from pyspark.sql import functions as F

from tidechart.sources import lake
from tidechart.streaming import jobs
from tidechart.streaming.history import history_rows, user_history

EVENTS = "event_id long, user_id string, region string, item string, action string, ts_ms long, title string"
ONCE = {"availableNow": True}
T0 = 1_700_000_000_000
MINUTE = 60_000


@pytest.fixture
def rocksdb(spark):
    keys = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"]
    before = {k: spark.conf.get(k, None) for k in keys}
    jobs.with_rocksdb(spark)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


class Replay:
    """Batches of events as files of a stream, and what the stream last said of each user."""

    def __init__(self, spark, at, **spans):
        self.spark, self.at, self.spans, self.said, self.n = spark, at, spans, {}, 0

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{self.at}/in/b{self.n:03d}")
            self.n += 1
        return self

    def run(self):
        source = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.at}/in")

        def keep(df, _):
            told = {}
            for r in df.collect():
                told.setdefault(r.user_id, []).append(tuple(r)[1:])
            self.said |= told

        q = user_history(lake.valid_events(source, ["event_id", "user_id"]), **self.spans).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.at}/ck").trigger(**ONCE).start()
        q.awaitTermination(240)
        return self

    def state(self):
        read = self.spark.read.format("statestore").option("stateVarName", "events").option("flattenCollectionTypes", "true").load(f"{self.at}/ck")
        return sorted((r.key.user_id, *tuple(r.list_element)) for r in read.collect())


def batch(spark, rows):
    told = {}
    for r in history_rows(lake.valid_events(spark.createDataFrame(rows, EVENTS), ["event_id", "user_id"])).collect():
        told.setdefault(r.user_id, []).append(tuple(r)[1:])
    return told


def key(row):
    return tuple(str(x) for x in row)


def same(got, want):
    assert {u: sorted(v, key=key) for u, v in got.items()} == {u: sorted(v, key=key) for u, v in want.items()}


def test_replays_in_any_order_agree_with_the_batch(spark, tmp_path, rocksdb):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(6)}", rng.choice(["r", "s", None]), rng.choice("abc"), rng.choice(["play", "like", "skip"]), T0 + rng.randrange(62 * MINUTE), rng.choice([None, "A"])) for i in range(160)]
    rows += rng.sample(rows, 25)  # repeats
    rows += [(900, "edge", "r", "a", "play", T0 + 40 * MINUTE, None), (901, "edge", "r", "b", "play", T0 + 10 * MINUTE, None), (902, "edge", "r", "c", "play", T0 + 10 * MINUTE + 1, None)]
    for seed in (1, 2):
        rng.shuffle(rows)
        # nothing is late: what comes lies within 62 minutes
        replay = Replay(spark, f"{tmp_path}/{seed}", late_minutes=40).add(*[rows[k::5] for k in range(5)]).run()
        want = batch(spark, rows)
        same(replay.said, want)
        assert {e[1] for e in replay.said["edge"]} == {"a", "c"}, "exactly half an hour back is out"
        assert sorted(map(key, replay.state())) == sorted(key((u, *e)) for u, es in want.items() for e in es), "each event is in the state once"


def test_a_restart_goes_on_from_the_state(spark, tmp_path, rocksdb):
    first = [(1, "u", "r", "a", "play", T0, None), (2, "u", "r", "b", "play", T0 + 20 * MINUTE, None), (3, "v", "r", "a", "play", T0, None)]
    then = [(4, "u", "s", "c", "like", T0 + 29 * MINUTE, None)]
    after = [(5, "u", "s", "d", "like", T0 + 45 * MINUTE, None)]
    replay = Replay(spark, str(tmp_path)).add(first).run()
    replay.said = {}
    replay.add(then).run()
    assert set(replay.said) == {"u"}, "only users with new events are handed on"
    same(replay.said, {"u": batch(spark, first + then)["u"]})
    replay.add(after).run()
    same(replay.said, {"u": batch(spark, first + then + after)["u"]})
    assert [e[1] for e in sorted(replay.said["u"])] == ["b", "c", "d"]


def test_idle_users_leave_the_state_and_late_rows_are_dropped(spark, tmp_path, rocksdb):
    at = lambda i, user, minute: (i, user, "r", f"i{i}", "play", T0 + minute * MINUTE, None)
    replay = Replay(spark, str(tmp_path)).add([at(1, "idle", 0), at(2, "busy", 0)], [at(3, "busy", 25)], [at(4, "busy", 63)]).run()
    assert {e[0] for e in replay.state()} == {"busy"}, "the watermark is at minute 31, half an hour after the last of the idle user"
    replay.add([at(5, "idle", 31), at(6, "idle", 32)]).run()
    assert [e[1] for e in replay.said["idle"]] == ["i6"], "minute 31 is 32 minutes late, minute 32 is not"
    replay.add([at(7, "busy", 200)], [at(8, "other", 201)]).run()
    assert {e[0] for e in replay.state()} == {"busy", "other"}
    assert [e[1] for e in replay.said["busy"]] == ["i7"]


def test_batches_of_histories(spark):
    rows = [(1, "u", "r", "a", "play", T0, "t"), (1, "u", "r", "a", "play", T0, "t"), (2, "u", "r", "b", "play", T0 + 30 * MINUTE, "t"), (3, "u", "r", "c", "play", T0 + 1, "t")]
    events = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.item for r in user_history(events).collect()) == ["b", "c"]
    assert sorted(r.item for r in user_history(events.drop("title"), span_minutes=31).collect()) == ["a", "b", "c"]
    assert user_history(events.limit(0)).count() == 0 and "title" not in user_history(events.drop("title")).columns
    assert user_history(events.withColumn("more", F.lit(1))).columns == ["user_id", "ts_ms", "item", "action", "region", "title"]
