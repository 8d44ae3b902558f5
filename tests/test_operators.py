"""Operators on tiny frames: ties, gaps, incomplete snapshots, permutations."""

from datetime import datetime

from pyspark.sql import functions as F

from tidechart.operators import detection, ranking, snapshots
from tidechart.operators.smoothing import Smoothed
from tidechart.plans import insights, regional, resolution, serving, similarity
from tidechart.sources.captured import explode_trend_payload, extract_embedded_json, extract_page_rows, flatten_sales


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_dedup_is_the_same_for_every_order_of_rows(spark):
    data = [(1, "b", 2), (1, "a", 2), (1, "c", 1), (2, None, None)]
    for d in (data, data[::-1]):
        assert rows(snapshots.dedup_latest(spark.createDataFrame(d, "k int, v string, t int"), ["k"], "t")) == [(1, "a", 2), (2, None, None)]


def test_day_window_is_half_open(spark):
    df = spark.createDataFrame([(1, "2024-01-01T00:00:00Z"), (2, "2024-01-02T23:59:59Z"), (3, "2024-01-03T00:00:00Z"), (4, "bad"), (5, None)], "id int, at string")
    assert [r[0] for r in rows(snapshots.day_window(df, snapshots.event_time([], ["at"]), 2, datetime(2024, 1, 2)))] == [1, 2]


def test_whole_latest_snapshot_of_a_period(spark):
    df = spark.createDataFrame([("c", "p1", "s1", 1, "a"), ("c", "p1", "s1", 1, "b"), ("c", "p1", "s2", 2, "a"), ("c", None, "s3", 3, "z"), ("c", None, "s4", 4, "y")], "g string, p string, s string, t int, i string")
    assert rows(snapshots.latest_per_period(df, ["g"], "p", "s", "t"), "s", "i") == [("c", "p1", "s2", 2, "a"), ("c", None, "s3", 3, "z"), ("c", None, "s4", 4, "y")]


def test_completeness(spark):
    df = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 2), ("b", 1, 1, 3), ("b", 2, 2, 3), ("c", 1, 1, 2), ("c", 1, 2, 2), ("d", 1, 1, 2), ("d", 2, 3, 2)], "s string, item int, rank int, size int")
    assert {r.s: r.is_complete for r in snapshots.completeness(df, ["s"], "item", "rank", "size").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_latest_in_batch_and_lists(spark):
    df = spark.createDataFrame([("c", 1, 1, "a"), ("c", 2, 1, "b"), ("c", 2, 1, "a"), ("c", 2, 2, "z")], "c string, t int, rank int, item string")
    assert rows(snapshots.latest_in_batch(df, ["c"], "t", "rank")) == [("c", 2, 1, "a"), ("c", 2, 2, "z")]
    kept, counts = snapshots.classify_lists(spark.createDataFrame([("editorial",), ("chart_mirror",), (None,), ("x",)], "k string"), "k")
    assert kept.count() == 1 and rows(counts) == [(1, 1, 2)]


def test_spearman_and_smoothing(spark):
    df = spark.createDataFrame([("g", i, 4 - i) for i in range(4)] + [("h", 1, 1)], "g string, a int, b int")
    got = {r.g: (r.n, r.rho) for r in ranking.spearman(df, ["g"], [F.col("a")], [F.col("b")], 3).collect()}
    assert got == {"g": (4, -1.0), "h": (1, None)}
    counts = spark.createDataFrame([("r", "x", 9.0), ("s", "y", 1.0)], "region string, item string, v double")
    cells = ranking.universe(counts.select("region"), counts.select("item"))
    got = {(r.region, r.item): round(r.share, 6) for r in Smoothed(counts, "region", "item", "v", 10.0).over(cells, "share").collect()}
    assert got[("r", "x")] == round((9 + 9) / 19, 6) and got[("s", "x")] == round(9 / 11, 6)


def test_lag_join_needs_the_later_day(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 5), ("a", "2024-01-02", 3), ("a", "2024-01-08", 1)], "k string, d string, rank int").withColumn("d", F.to_date("d"))
    assert [(r.lag_days, r.rank_before, r.rank_after) for r in ranking.lag_join(df, ["k"], "d", (1, 3, 7), ["rank"]).orderBy("lag_days").collect()] == [(1, 5, 3), (7, 5, 1)]


def test_lifecycle(spark):
    def chart(period, ranks, size=None):
        return [("c", period, item, r, size or len(ranks)) for item, r in ranks.items()]

    data = chart("1", {"up": 4, "down": 1, "flat": 2, "gone": 3}) + chart("2", {"up": 3, "down": 2, "flat": 1, "gone": 4}) + chart("3", {"up": 2, "down": 3, "flat": 1, "gone": 4}) + chart("4", {"up": 1, "down": 3, "flat": 2})
    df = spark.createDataFrame(data, "chart string, period string, item string, rank int, chart_size int")
    got = {r.item: r.status for r in insights.track_lifecycle(df).collect()}
    assert got == {"up": "rising", "down": "stable", "flat": "stable", "gone": "left_chart"}
    partial = spark.createDataFrame(data[:-3] + chart("4", {"up": 1, "flat": 2}, 3), df.schema)
    got = {r.item: r.status for r in insights.track_lifecycle(partial).collect()}
    assert got["gone"] == "stable"
    few = insights.track_lifecycle(df.where("period <= '2'"))
    assert {r.status for r in few.collect()} == {"insufficient_data"}


def test_countries_need_the_same_whole_period(spark):
    data = [("A", "1", i, i, 2, 10.0) for i in (1, 2)] + [("B", "1", i + 1, i, 2, 5.0) for i in (1, 2)] + [("A", "2", i, i, 2, 1.0) for i in (1, 2)] + [("B", "2", 1, 1, 2, 1.0)]
    df = spark.createDataFrame(data, "country string, period string, item int, rank int, chart_size int, metric_value double")
    got = {(r.item, r.country): r.stream_share for r in insights.compare_countries(df, ["A", "B"], 2).collect()}
    assert got == {(1, "A"): 0.5, (2, "A"): 0.5, (3, "A"): None, (1, "B"): None, (2, "B"): 0.5, (3, "B"): 0.5}
    assert rows(insights.complete_periods(df, ["A", "B"])[1]) == [("B", "2")]


def test_feedback_counts_an_event_once(spark):
    data = [("e1", "t", "play", "web", "u")] * 2 + [("e2", "t", "skip", "web", "u"), ("e3", "t", "like", None, "v"), (None, "t", "play", "web", "u"), ("e4", "t", "other", "web", "u")]
    df = spark.createDataFrame(data, "event_id string, item string, action string, source string, user_id string")
    got = insights.feedback_summary(df, F.col("item"), "web").first()
    assert (got.play, got.skip, got.likes, got.skip_rate, got.users) == (1, 1, 0, 0.5, 1)
    assert rows(insights.source_counts(df)) == [("unknown", 1), ("web", 2)]
    assert insights.feedback_summary(df, F.col("item"), "unknown").first().skip_rate is None


def test_greedy_clusters(spark):
    data = [("la-viem-song", "k1", 5, ["dat-g"]), ("la-viem-song", "k2", 3, ["datg-music"]), ("la-viem-song", "k3", 2, ["st-entertainment"]), ("la-viem-song", "k4", 1, ["xy"]), ("abc", "s1", 2, ["label-records"]), ("abc", "s2", 1, ["singer"])]
    got = dict(rows(resolution.greedy_clusters(spark.createDataFrame(data, "block string, key string, n long, names array<string>"), "block", "key", "n", "names")))
    assert got == {"k2": "k1"}
    got = dict(rows(resolution.greedy_clusters(spark.createDataFrame([d for d in data if d[1] != "k4"], "block string, key string, n long, names array<string>"), "block", "key", "n", "names")))
    assert got == {"k2": "k1", "k3": "k1"}


def test_mentions(spark):
    names = spark.createDataFrame([("Nghệ An", "NA"), ("Huế", "H"), ("Hà Nội", "HN"), ("Sơn La", "SL")], "name string, code string")
    terms = detection.aliases(names, "name", "code", ["son la"])
    posts = [
        (1, "Ai ở Nghệ An điểm danh", ""), (2, "nghe an yên bình", ""), (3, "que minh o nghe an ne", ""), (4, "Hà Nội mùa thu đẹp quá", ""), (5, "Hà Nội ơi", "Nhớ Hà Nội"),
        (6, "Director: abc, Huế", ""), (7, "a\nb\nc\nd\nHuế", ""), (8, "con son la gi", ""), (9, None, None), (10, "Huế có ai không", None),
    ]
    df = spark.createDataFrame(posts, "id int, text string, title string")
    got = {(r.id, r.code): r.kind for r in detection.mentions(df, "id", "text", "title", terms).collect()}
    assert got == {(1, "NA"): "self", (3, "NA"): "self", (4, "HN"): "mention", (10, "H"): "self"}


def test_votes(spark):
    df = spark.createDataFrame([("r", "i", "a", 0.3, "mention"), ("r", "i", "a", 1.0, "self"), ("r", "i", "b", 0.3, "mention")], "r string, i string, a string, w double, k string")
    assert rows(detection.one_vote_per_author(df, "r", "i", "a", "w", "k")) == [("r", "i", 1.3, 2, 1)]


def test_similarity(spark):
    data = [(b, i, p, 1.0) for b in ("x", "y") for p, i in enumerate((1, 2, 3))] + [("z", 1, 0, 1.0), ("z", 9, 1, 1.0)]
    baskets = spark.createDataFrame(data, "basket string, item int, position int, w double")
    items = spark.createDataFrame([(1, "a", "t"), (9, "a", "u"), (2, None, "v")], "item int, artist string, title string")
    got = {(r.item, r.neighbour): (round(r.sim, 4), r.baskets) for r in similarity.item_similarity(baskets, items).collect()}
    assert got[(2, 3)] == (0.4, 2) and got[(1, 9)] == (0.15, 0) and (9, 2) not in got
    assert similarity.capped_baskets(baskets, 2).where("basket = 'x'").count() == 2


def test_similarity_of_an_artist_with_many_items(spark):
    baskets = spark.createDataFrame([(b, i, p, 1.0) for b in ("x", "y") for p, i in enumerate((2, 240, 250))], "basket string, item int, position int, w double")
    artists = {i: "a" for i in range(1, 251)} | {i: "b" for i in range(251, 290)}
    items = spark.createDataFrame([*artists.items(), (300, None)], "item int, artist string")
    got = {}
    for r in similarity.item_similarity(baskets, items).collect():
        got.setdefault(r.item, []).append((r.rank, r.neighbour, round(r.sim, 6), r.baskets))
    co = round(2 / (2 + 3.0) + 0.15, 6)
    met = {2: (240, 250), 240: (2, 250), 250: (2, 240)}
    for i, a in artists.items():
        near = [(n, co, 2) for n in met.get(i, ())] + [(n, 0.15, 0) for n in sorted(artists) if artists[n] == a and n != i and n not in met.get(i, ())]
        assert sorted(got[i]) == [(place + 1, *x) for place, x in enumerate(near[:30])], i
    assert set(got) == set(artists)


def test_merge_and_recommend(spark):
    batch = spark.createDataFrame([("r", "a", 1, 1.0, 0.5, 0.5, 0.0, 0.0)], "region string, item string, rank int, score double, c_national double, c_trends double, c_mentions double, c_events double")
    plays = spark.createDataFrame([("r", "b", 10, 0), ("r", "z", 0, 0)], "region string, item string, plays long, likes long")
    said = spark.createDataFrame([("r", "a", 2.0)], "region string, item string, mentions double")
    got = {r.item: (round(r.score, 6), r.rank, r.rank_change) for r in serving.merge_trending(batch, plays, said).collect()}
    assert got == {"a": (0.7, 1, 0), "b": (0.3, 2, None)}
    assert [r.item for r in serving.merge_trending(batch, plays, said, "realtime").orderBy("rank").collect()] == ["b", "a"]
    seeds = spark.createDataFrame([("u", "r", "a", 1.0), ("v", "r", "b", -1.0)], "user_id string, region string, item string, w double")
    sim = spark.createDataFrame([("a", "c", 0.5), ("a", "b", 0.1)], "item string, neighbour string, sim double")
    hot = spark.createDataFrame([("r", "a", 1.0), ("r", "d", 0.5)], "region string, item string, trend double")
    got = rows(serving.recommend(seeds, sim, hot).select("user_id", "rank", "item"))
    assert got == [("u", 1, "c"), ("u", 2, "b"), ("u", 3, "d"), ("v", 1, "a"), ("v", 2, "d")]


def test_interest_ratio_edges(spark):
    data = [("f", "c", "x", 4.0, 0.0, True, False, 2.0), ("f", "c", "y", None, 0.0, False, False, 2.0), ("g", "c", "x", 4.0, None, True, False, 1.0), ("f", "c", "z", 0.0, 0.0, True, True, 2.0)]
    df = spark.createDataFrame(data, "fine string, coarse string, item string, share double, anchor_share double, has_data boolean, is_anchor boolean, fine_weight double")
    assert {r.item: r.ratio for r in regional.interest_ratio(df).collect()} == {"x": 8.0, "y": 0.0, "z": 1.0}


def test_captured(spark):
    pages = spark.createDataFrame([(1, "<tr><td>1</td><a href='/t/1'>A</a></tr><tr><td>2</td></tr><script>var rows = [{\"r\":1,\"t\":\"vn\"},{\"r\":2,\"t\":\"th\"}];</script>"), (2, None)], "id int, html string")
    assert rows(extract_page_rows(pages, "id", "html", r"(?s)<tr>.*?</tr>", {"rank": r"<td>(\d+)</td>", "link": r"href='([^']*)'"})) == [(1, 1, "1", "/t/1"), (1, 2, "2", "")]
    assert rows(extract_embedded_json(pages, "id", "html", "rows", "struct<r:int,t:string>", F.col("t") == "vn")) == [(1, 1, 1, "vn")]
    payload = ")]}',\n" + '{"default":{"geoMapData":[{"geoCode":"A","geoName":"a","value":[5,0],"hasData":[true,false]}]}}'
    assert rows(explode_trend_payload(spark.createDataFrame([(1, payload), (2, "x")], "id int, p string"), "id", "p")) == [(1, "A", "a", 0, 5, True), (1, "A", "a", 1, None, False)]
    sale = '{"events":[{"utc_date":10.0,"items":[{"item_type":"a","artist_name":"x","amount_paid":2.5},{"item_type":"q"}]}]}'
    got = flatten_sales(spark.createDataFrame([(sale,)], "p string"), "p").collect()
    assert [(r["product"], r.amount_paid, len(r.fingerprint)) for r in got] == [("album", 2.5, 64), ("other", None, 64)]
