"""Round trips of the lake and sinks, and streams against the same rows in batch."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidechart.sources import lake, sinks
from tidechart.streaming import jobs

ONCE = {"availableNow": True}


def test_lake_round_trip(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("ts_ms", T.LongType())])
    assert lake.read_raw(spark, base, "events", schema).count() == 0
    df = spark.createDataFrame([(1, 0), (2, 86_400_000)], "id int, ts_ms long")
    lake.seed_lake(df, base, F.lit("events"), F.col("ts_ms"))
    assert {tuple(r) for r in lake.read_raw(spark, base, "events", schema).select("id", "dt").collect()} == {(1, "1970-01-01"), (2, "1970-01-02")}
    assert lake.read_raw(spark, base, "events", schema, since="1970-01-02").count() == 1


def test_archives(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\ufeff{"action":"play","id":1}\n\n{"value":{"rank":3,"chart_id":"c"}}\n{"action":"play","id":1}\nnot json\n[1, 2]\n', encoding="utf-8")
    schema = T.StructType.fromDDL("record_type string, action string, rank int, chart_id string, id int")
    records, errors = lake.read_jsonl(spark, [str(tmp_path / "a.jsonl")], schema)
    assert {r.record_type for r in records.collect()} == {"event", "chart_entry"} and records.count() == 2
    assert sorted(r.error for r in errors.collect()) == ["a.jsonl:5: JSONDecodeError", "a.jsonl:6: TypeError"]


def test_lines_of_split_archives_are_numbered(spark, tmp_path):
    rows = [f'{{"action":"play","id":{i}}}' if i % 97 else "broken" for i in range(1, 2000)]
    (tmp_path / "b.jsonl").write_text("\n".join(rows), encoding="utf-8")
    schema = T.StructType.fromDDL("record_type string, action string, rank int, chart_id string, id int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        records, errors = lake.read_jsonl(spark, [str(tmp_path / "b.jsonl")], schema)
        assert records.count() == sum(r != "broken" for r in rows)
        assert {r.error for r in errors.collect()} == {f"b.jsonl:{i}: JSONDecodeError" for i in range(97, 2000, 97)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chart_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Chart of the day\n\nrank,track_name,artist_names,uri,streams\n1,"One, two",A,x:1,"1,234"\n2,B,C,x:2,99\nfoot,,,,\n', encoding="utf-8")
    got = [tuple(r)[1:] for r in lake.read_chart_csv(spark, str(tmp_path / "c.csv")).orderBy("rank").collect()]
    assert got == [(1, "One, two", "A", "x:1", 1234), (2, "B", "C", "x:2", 99)]


def test_views_keep_the_last_versions(spark, tmp_path):
    base = str(tmp_path)
    assert lake.read_view(spark, base, "v") is None
    for k in range(5):
        sinks.write_view(spark.range(k + 1).toDF("x"), base, "v", f"r{k}", datetime(2024, 1, 1 + k))
    assert lake.read_view(spark, base, "v").count() == 5
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if p.name.startswith("run_id")) == ["run_id=r2", "run_id=r3", "run_id=r4"]


def test_views_are_kept_by_time_and_not_by_name(spark, tmp_path):
    base = str(tmp_path)
    runs = lambda: sorted(p.name for p in (tmp_path / "v").iterdir() if p.name.startswith("run_id"))
    for k in (8, 9, 10, 11):
        sinks.write_view(spark.range(k).toDF("x"), base, "v", str(k), datetime(2024, 1, k), keep=2)
        assert lake.read_view(spark, base, "v").count() == k
    assert runs() == ["run_id=10", "run_id=11"]
    sinks.write_view(spark.range(3).toDF("x"), base, "v", "late", datetime(2023, 1, 1), keep=2)
    assert runs() == ["run_id=11", "run_id=late"] and lake.read_view(spark, base, "v").count() == 3
    sinks.replace_view(spark.range(4).toDF("x"), base, "v", "only", datetime(2024, 2, 1))
    assert runs() == ["run_id=only"] and lake.read_view(spark, base, "v").count() == 4


def test_upsert_takes_the_last_write_of_equal_times(spark, tmp_path):
    base = str(tmp_path)
    put = lambda *rows, **k: sinks.upsert(spark.createDataFrame(rows, "id string, plays int, at int"), base, "t", "id", "at", 4, **k)
    told = lambda: sorted(tuple(r) for r in sinks.read_upserted(spark, base, "t").select("id", "plays", "at").collect())
    put(("a", 9, 5), ("b", 1, 1))
    put(("a", 2, 5))
    put(("a", 2, 5))
    assert told() == [("a", 2, 5), ("b", 1, 1)]
    put(("a", 7, 4))
    assert told() == [("a", 2, 5), ("b", 1, 1)]
    reader = sinks.read_upserted(spark, base, "t")
    put(("c", 3, 1), bucket_bytes=1)
    assert told() == [("a", 2, 5), ("b", 1, 1), ("c", 3, 1)] and reader.count() == 2, "a reader that has begun keeps its files"
    assert {r["buckets"] for r in sinks.published(spark, f"{base}/t/_manifest", sinks.TABLE) if r["live"]} == {8}


def test_a_late_event_changes_the_count_that_is_served(spark, tmp_path):
    at = 1_700_000_000_000 // 60_000 * 60_000
    rows = [(1, "u", "r", "a", "play", at + 50_000), (2, "v", "r", "a", "play", at + 10_000), (3, "w", "r", "a", "play", at + 50_000)]
    stream = _events(spark, str(tmp_path / "in"), [rows[:1], rows[1:2], rows[2:]])
    q = jobs.keyed_sink(jobs.plays_per_minute(stream), str(tmp_path / "out"), "plays", "last_ts_ms", str(tmp_path / "ck"), trigger=ONCE)
    q.awaitTermination(120)
    assert [(r.plays, r.listeners) for r in sinks.read_upserted(spark, str(tmp_path / "out"), "plays").collect()] == [(3, 3)]


def test_upsert_and_archive_ids(spark, tmp_path):
    base = str(tmp_path)
    sinks.upsert(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, v int, at int"), base, "t", "id", "at", 4)
    again = spark.createDataFrame([("a", 2, 2), ("c", 1, 1)], "id string, v int, at int")
    for _ in range(2):
        sinks.upsert(again, base, "t", "id", "at", 4)
    assert sorted(tuple(r) for r in sinks.read_upserted(spark, base, "t").select("id", "v").collect()) == [("a", 2), ("b", 1), ("c", 1)]
    old = spark.createDataFrame([("x", 1)], "v string, at int")
    for _ in range(2):
        sinks.import_archive(old, base, "arch", "at")
    assert sinks.read_upserted(spark, base, "arch").count() == 1


EVENTS = "event_id long, user_id string, region string, item string, action string, ts_ms long"


def _events(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    return lake.valid_events(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), ["event_id"])


def test_plays_in_stream_and_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", "r", f"i{i % 2}", ["play", "skip", "like"][i % 3], 1_700_000_000_000 + i * 7000) for i in range(60)]
    stream = _events(spark, str(tmp_path / "in"), [rows[:40], rows[30:]])
    q = jobs.keyed_sink(jobs.plays_per_minute(stream), str(tmp_path / "out"), "plays", "last_ts_ms", str(tmp_path / "ck"), trigger=ONCE)
    q.awaitTermination(120)
    got = {tuple(r) for r in sinks.read_upserted(spark, str(tmp_path / "out"), "plays").select("doc_id", "plays", "skips", "likes").collect()}
    batch = lake.valid_events(spark.createDataFrame(rows, EVENTS), ["event_id"])
    assert got == {tuple(r) for r in jobs.plays_docs(jobs.plays_by_minute(batch)).select("doc_id", "plays", "skips", "likes").collect()}


def test_recommendations_in_a_stream(spark, tmp_path):
    at = 1_700_000_000_000
    rows = [(1, "u", "r", "a", "play", at), (2, "u", "r", "b", "like", at + 60_000), (3, "v", "s", "a", "skip", at), (4, "u", "r", "old", "play", at - 3_600_000)]
    stream = _events(spark, str(tmp_path / "in"), [rows])
    sim = spark.createDataFrame([("a", "c", 0.9), ("old", "d", 0.9)], "item string, neighbour string, sim double")
    hot = spark.createDataFrame([("r", "e", 1.0), ("s", "f", 1.0)], "region string, item string, trend double")
    q = jobs.stream_recommendations(stream, lambda: jobs.Views(sim, hot), lambda: F.lit(at + 120_000), str(tmp_path / "out"), "reco", str(tmp_path / "ck"), ONCE)
    q.awaitTermination(120)
    got = {r.user_id: r for r in sinks.read_upserted(spark, str(tmp_path / "out"), "reco").collect()}
    assert [(i["item"], i["reason"]) for i in got["u"]["items"]] == [("c", "because of a"), ("e", "popular in your region")]
    assert [i["item"] for i in got["v"]["items"]] == ["f"] and got["u"].events == 2


def test_ingest_and_mirror(spark, tmp_path):
    raw = spark.createDataFrame([("t", "k", '{"id":1}', datetime(2024, 1, 1), 0, 5), ("t", "k", '{"id":2}', datetime(2024, 1, 2), 0, 6)], "topic string, key string, value string, kafka_ts timestamp, partition int, offset long")
    raw.write.parquet(str(tmp_path / "in"))
    source = {"format": "parquet", "path": str(tmp_path / "in")}
    stream = lake.event_stream(spark, source, 1, raw.schema)
    sinks.ingest(stream, str(tmp_path / "lake"), str(tmp_path / "ck1"), ONCE).awaitTermination(120)
    got = lake.read_raw(spark, str(tmp_path / "lake"), "t", T.StructType.fromDDL("id int"))
    assert {(r.id, str(r.dt)) for r in got.collect()} == {(1, "2024-01-01"), (2, "2024-01-02")}
    for k in ("a", "b"):  # a second reader of the same records changes nothing
        sinks.ingest_keyed(lake.event_stream(spark, source, 1, raw.schema), str(tmp_path / "es"), "raw", str(tmp_path / f"ck{k}"), ONCE).awaitTermination(120)
    assert sorted(r.doc_id for r in sinks.read_upserted(spark, str(tmp_path / "es"), "raw").collect()) == ["t:0:5", "t:0:6"]


def test_charts_are_replaced_whole(spark):
    from tidechart.operators.snapshots import latest_in_batch

    df = spark.createDataFrame([("c", "s", 1, 1, "a", "t"), ("c", "s", 1, 2, "b", "t"), ("c", "s", 2, 1, "z", "t")], "chart_id string, chart_scope string, crawled_ms long, rank int, item string, title string")
    assert [r.item for r in latest_in_batch(df, ["chart_id", "chart_scope"], "crawled_ms", "rank").collect()] == ["z"]


def test_views_are_read_again_by_age(spark, tmp_path):
    base, now = str(tmp_path), [1000.0]
    cache = lake.ViewCache(spark, base, 300, lambda: now[0])
    assert cache.get("v") is None
    sinks.write_view(spark.range(2).toDF("x"), base, "v", "a", datetime(2024, 1, 1))
    assert cache.get("v").count() == 2, "a view that was missing is looked for again"
    sinks.write_view(spark.range(5).toDF("x"), base, "v", "b", datetime(2024, 1, 2))
    now[0] += 299
    assert cache.get("v").count() == 2
    now[0] += 2
    assert cache.get("v").count() == 5


def test_recommendations_without_a_regional_ranking(spark):
    from tidechart.plans.serving import recommend

    seeds = spark.createDataFrame([("u", "r", "a", 1.0), ("v", "s", "a", 1.0)], "user_id string, region string, item string, w double")
    sim = spark.createDataFrame([("a", "c", 0.9)], "item string, neighbour string, sim double")
    hot = spark.createDataFrame([("r", "e", 1.0)], "region string, item string, trend double")
    popular = spark.createDataFrame([("a", 1.0), ("p", 0.8), ("q", 0.5)], "item string, national_score double")
    told = lambda *args, **k: {u: [r["item"] for r in rows] for u in "uv" for rows in [sorted((r for r in recommend(seeds, *args, **k).collect() if r.user_id == u), key=lambda r: r["rank"])]}
    assert told(sim, hot, popular=popular) == {"u": ["c", "e"], "v": ["c", "p", "q"]}
    assert told(sim, None, popular=popular) == {"u": ["c", "p", "q"], "v": ["c", "p", "q"]}
    assert told(None, hot) == {"u": ["e"], "v": []}
    assert told(None, None) == {"u": [], "v": []}


def test_recommendations_by_title_and_canonical_key(spark, tmp_path):
    at = 1_700_000_000_000
    rows = [(1, "u", "r", "a2", "play", at, "Song A"), (2, "u", "r", "b", "like", at, "Song B")]
    events = spark.createDataFrame(rows, EVENTS + ", title string").withColumn("ts", F.timestamp_millis("ts_ms"))
    views = jobs.Views(
        spark.createDataFrame([("a", "c", 0.9)], "item string, neighbour string, sim double"), None,
        spark.createDataFrame([("c", "Song C", 0.2, ["X"]), ("a", "Song A", 0.9, ["Y"]), ("z", "Song Z", 0.5, ["Z"])], "item string, title string, national_score double, artists array<string>"),
        spark.createDataFrame([("a2", "a")], "alias_key string, canonical_key string"),
    )
    got = jobs.recommendation_docs(jobs.user_history(events), views, F.lit(at)).first()
    assert [(i["item"], i["title"], i["artists"], i["reason"]) for i in got["items"]] == [("c", "Song C", ["X"], "because of Song A"), ("z", "Song Z", ["Z"], "popular in your region")]
    assert [(r["item"], r["title"]) for r in got["recent"]] == [("a2", "Song A"), ("b", "Song B")]


COMMENTS = "comment_id string, text string, title string, published_ms long, crawled_ms long"


def test_mentions_in_a_stream(spark, tmp_path):
    from tidechart.operators.detection import aliases

    rows = [("c1", "Quê em ở Nghệ An nhé", "bài hát", None, 5), ("c2", "yeu ha noi qua", "Hà Nội mùa thu", 2, 6), ("c3", "nothing here", None, 3, 7), (None, "Nghệ An", None, 3, 7), ("c4", None, None, 3, 7)]
    spark.createDataFrame(rows, COMMENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    terms = aliases(spark.createDataFrame([("Nghệ An", "NA"), ("Hà Nội", "HN")], "name string, code string"), "name", "code", [])
    stream = spark.readStream.schema(COMMENTS).parquet(str(tmp_path / "in"))
    for k in ("a", "b"):  # a second reader of the same comments changes nothing
        jobs.stream_mentions(stream, terms, str(tmp_path / "out"), "mentions", str(tmp_path / f"ck{k}"), ONCE).awaitTermination(120)
    got = sorted((r.comment_id, r.code, r.kind, r.published_ms, r.snippet) for r in sinks.read_upserted(spark, str(tmp_path / "out"), "mentions").collect())
    assert got == [("c1", "NA", "self", 5, rows[0][1]), ("c2", "HN", "mention", 2, rows[1][1])] or got == [("c1", "NA", "self", 5, rows[0][1])]


CHARTS = "chart_id string, chart_scope string, crawled_ms long, rank int, item string, title string"


def test_charts_in_a_stream(spark, tmp_path):
    batches = [[("c", "s", 1, 1, "a", "A"), ("c", "s", 1, 2, "b", "B"), ("d", "s", 1, 1, "x", "X")], [("c", "s", 2, 1, "z", "Z"), ("c", "s", 2, None, "n", "N"), (None, "s", 9, 1, "n", "N")], [("c", "s", 1, 1, "late", "L")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHARTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(CHARTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    jobs.stream_charts(stream, str(tmp_path / "out"), "charts", str(tmp_path / "ck"), ONCE).awaitTermination(120)
    got = {r.chart_id: [e["item"] for e in r.entries] for r in sinks.read_upserted(spark, str(tmp_path / "out"), "charts").collect()}
    assert got == {"c": ["z"], "d": ["x"]}


def test_state_in_rocksdb_and_progress(spark, tmp_path):
    keys = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"]
    before = {k: spark.conf.get(k, None) for k in keys}
    log = sinks.ProgressLog()
    spark.streams.addListener(log)
    try:
        jobs.with_rocksdb(spark)
        rows = [(i, f"u{i % 3}", "r", "i", "play", 1_700_000_000_000 + i) for i in range(20)]
        stream = _events(spark, str(tmp_path / "in"), [rows, rows])
        q = jobs.keyed_sink(jobs.plays_per_minute(stream), str(tmp_path / "out"), "plays", "last_ts_ms", str(tmp_path / "ck"), trigger=ONCE)
        q.awaitTermination(120)
        assert "RocksDB" in spark.conf.get(keys[0])
        got = sinks.read_upserted(spark, str(tmp_path / "out"), "plays").first()
        assert (got.plays, got.listeners) == (20, 3)
        for _ in range(100):
            if sum(r["input_rows"] for r in log.rows) >= 40:
                break
            time.sleep(0.1)
        log.flush(spark, str(tmp_path / "m"))
        kept = spark.read.parquet(str(tmp_path / "m" / "_metrics"))
        assert kept.where("query = 'plays'").agg(F.sum("input_rows")).first()[0] == 40 and not log.rows
    finally:
        spark.streams.removeListener(log)
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_the_first_query_to_end_ends_the_application(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    spark.streams.resetTerminated()
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 hour").start()
    turns = []

    def each():
        turns.append(1)
        if len(turns) == 2:
            q.stop()

    with pytest.raises(SystemExit):
        jobs.run_all(spark, 1, each)
    assert len(turns) >= 2
    spark.streams.resetTerminated()


def test_metadata_and_parsed_values(spark, tmp_path):
    for k in range(2):
        sinks.put_meta(spark, str(tmp_path), "batch_views", {"run_id": f"r{k}", "seconds": 1.5})
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "_meta")).select("name", "run_id", "seconds").collect()) == [("batch_views", "r0", "1.5"), ("batch_views", "r1", "1.5")]
    raw = spark.createDataFrame([('{"id":1,"x":"y"}',), ("broken",), (None,)], "value string")
    got = [tuple(r) for r in lake.parse_stream(raw, T.StructType.fromDDL("id int, x string")).collect()]
    assert got == [(1, "y"), (None, None), (None, None)]


def test_mention_rows_and_canonical_keys(spark):
    from tidechart.operators.ranking import rewrite_keys
    from tidechart.operators.snapshots import feed_overlap, mention_rows

    got = mention_rows(spark.createDataFrame([(None, 5, "x" * 400), (3, 5, None)], "p long, c long, t string"), "p", "c", "t").collect()
    assert [(r.published_ms, r.snippet) for r in got] == [(5, "x" * 300), (3, None)]
    alias = spark.createDataFrame([("a2", "a")], "alias_key string, canonical_key string")
    own = spark.createDataFrame([("a2", 1), ("b", 2), (None, 3)], "item string, n int")
    assert sorted(rewrite_keys(own, alias, "item").collect(), key=lambda r: r.n) == [("a", 1), ("b", 2), (None, 3)]
    old = spark.createDataFrame([("a", 1, 10), ("b", None, 11), ("b", None, 11)], "x string, y int, at int")
    new = spark.createDataFrame([("b", None, 11), ("c", 2, 12), ("d", 3, 14)], "x string, y int, at int")
    assert tuple(feed_overlap(old, new, ["x", "y", "at"], "at", F.lit(11)).first()) == (3, 3, 2, 14, 1)


def test_system_figures(spark):
    from tidechart.plans.serving import system_kpis

    evidence = spark.createDataFrame([("r", "high", 2), ("s", "low", 1), ("t", "high", None)], "region string, confidence_label string, self_mentions long")
    trends = spark.createDataFrame([("a", 5), ("a", 7), ("b", 6)], "item string, seen long")
    sources = spark.createDataFrame([("x", 9, 2, "d2")], "source string, records long, snapshots long, last_snapshot string")
    got = system_kpis({"catalog_items": spark.range(4), "aliases": spark.range(0)}, evidence, trends, sources, {"national": 0.35, "trends": 0.35}).first()
    assert (got.regions_high_confidence, got.regions_medium_confidence, got.self_mentions, got.trend_records, got.trend_items, got.catalog_items, got.aliases) == (2, 0, 3, 3, 2, 4, 0)
    assert [tuple(s) for s in got.sources] == [("trends", 3, 2, "7"), ("x", 9, 2, "d2")] and got.weights == {"national": 0.35, "trends": 0.35}


def test_catalog_links_and_genre(spark):
    from tidechart.plans.resolution import build_catalog

    rows = [("k", "Old", ["A"], "Rap Việt", "s1", 1, "p1", "u1", None, 10), ("k", "New", ["A", "B"], "Hip-Hop", "s2", 2, "p2", "u2", "t", 12), ("k", "New", ["A"], None, "s2", 2, None, "u3", None, None)]
    df = spark.createDataFrame(rows, "key string, title string, artists array<string>, genre string, source string, seen long, platform_id string, url string, thumbnail string, duration_s int")
    got = build_catalog(df).first()
    assert (got.title, got.artists, got.genre, got.thumbnail, got.duration_s) == ("New", ["A", "B"], "Rap Việt", "t", 12)
    assert [tuple(x) for x in got.links] == [("s1", "p1", "u1"), ("s2", "p2", "u2")]
