"""Literal expectations of text and scoring functions."""

import pytest
from pyspark.sql import functions as F

from tidechart.functions import scoring, text


@pytest.fixture(scope="module")
def value(spark):
    def run(make, *args, kinds="string"):
        names = [f"c{i}" for i in range(len(args))]
        kind = [kinds] * len(args) if isinstance(kinds, str) else kinds
        df = spark.createDataFrame([args], ", ".join(f"{n} {k}" for n, k in zip(names, kind)))
        return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("given, want", [("Sơn Tùng M-TP", "son tung m tp"), ("Đà Lạt!!", "da lat"), (None, ""), ("  A__b  ", "a b"), ("ŒUVRE é", "uvre e"), ("…", "")])
def test_norm_text(value, given, want):
    assert value(text.norm_text, given) == want
    assert value(text.slug, given) == want.replace(" ", "-")


def test_accents(value):
    assert value(text.strip_accents, "Đêm Ấy é") == "Dem Ay e"
    assert value(text.has_diacritics, "êm") and not value(text.has_diacritics, "em") and not value(text.has_diacritics, None)


@pytest.mark.parametrize("given, want", [("Song (feat. X)", "Song"), ("Song [Official MV] | Lyrics", "Song"), ("Song ft. Someone", "Song"), ("Song (Part 2)", "Song (Part 2)"), ("(Official Video)", "(Official Video)"), (None, ""), ("A   B", "A B")])
def test_clean_title(value, given, want):
    assert value(text.clean_title, given) == want


@pytest.mark.parametrize("given, want", [("A & B, C", ["A", "B", "C"]), ("A x B", ["A", "B"]), ("Alex", ["Alex"]), ("A ft. B", ["A", "B"]), ("A và B", ["A", "B"]), (None, []), (" , ", []), ("Ann with Bob", ["Ann", "Bob"])])
def test_split_artists(value, given, want):
    assert value(text.split_artists, given) == want


def test_names_of_channels_and_videos(value):
    assert value(text.clean_channel_name, "DatG Music") == "DatG"
    assert value(text.clean_channel_name, "Abc Official Channel") == "Abc"
    kinds = ["string", "array<string>"]
    video = lambda t, a: value(text.clean_video_title, t, a, kinds=kinds)
    assert video("NAME ONE x OTHER | 'THE SONG' | OFFICIAL MV", ["Name One", "Other"]) == "THE SONG"
    assert video("THE SONG - NAME ONE | OFFICIAL MUSIC VIDEO", ["Name One"]) == "THE SONG"
    assert video("Name One - The Song", ["Name One Official"]) == "The Song"
    assert video("Plain", []) == "Plain" and video(None, None) == ""


def test_track_key(value):
    kinds = ["string", "array<string>"]
    a = value(text.track_key, "Tìm Em (Official MV)", ["HNgle"], kinds=kinds)
    assert a == value(text.track_key, "TIM EM", ["hngle & Other"], kinds=kinds) == "tim-em__hngle"
    assert value(text.track_key, "", None, kinds=kinds) == "unknown__unknown"


@pytest.mark.parametrize("given, want", [("1,2K", 1200), ("3.4M", 3_400_000), ("12 N", 12000), ("1.234", 1234), ("1,234,567", 1234567), (None, 0), ("none", 0), ("2 TR", 2_000_000)])
def test_parse_count(value, given, want):
    assert value(text.parse_count, given) == want


@pytest.mark.parametrize("genres, title, artists, want", [(["Rap/Hip Hop"], "Đêm", [], "Rap Việt"), (["Hip-Hop"], "Night", [], "US-UK"), (["K-Pop"], "Song", [], "K-Pop/Châu Á"), (["K-Pop"], "Tình", [], "V-Pop"), (["Bolero"], "", [], "Nhạc Trữ Tình"), ([], "x", [], "Khác"), (None, "Mưa", [], "V-Pop"), (["US-UK Pop"], "x", [], "US-UK"), (["Dance"], "x", ["Đức"], "EDM/Remix")])
def test_genre_bucket(value, genres, title, artists, want):
    assert value(text.genre_bucket, genres, title, artists, kinds=["array<string>", "string", "array<string>"]) == want


def test_more_text(value):
    assert value(text.genre_hint, "Top 100 Nhạc Trữ Tình Hay Nhất") == "Nhạc Trữ Tình"
    assert value(text.light_text, "Thanh HOÁ, ơi!") == "thanh hóa ơi"
    assert value(text.search_query, "One two three four five six seven", ["Two Eight Nine"], kinds=["string", "array<string>"]) == "One two three four five six Eight"


@pytest.mark.parametrize("given, want", [("PT3M20S", 200), ("PT1H", 3600), ("P1DT1S", 86401), ("x", None), (None, None)])
def test_iso_duration(value, given, want):
    assert value(scoring.iso_duration_s, given) == want


def test_ids_and_ranks(value):
    import hashlib

    assert value(lambda c: scoring.salted_hash(c, "s"), "id") == hashlib.sha256(b"s:id").hexdigest()[:16]
    assert value(lambda c: scoring.salted_hash(c, None, 20), None) is None
    assert [value(scoring.previous_rank, 5, m, kinds=["int", "string"]) for m in ("+2", "-1", "=", "new")] == [7, 4, 5, None]
    assert value(lambda c, m: scoring.snapshot_id(c, m, 30), "c", 1_700_000_000_000, kinds=["string", "long"]) == "c@20231114T2200"
    assert value(scoring.rank_gain, 3, 5, 10, 1.0, kinds=["int", "int", "int", "double"]) == pytest.approx(0.2)
    assert value(scoring.rank_gain, 3, 0, 10, 1.0, kinds=["int", "int", "int", "double"]) is None
    assert value(scoring.placement_score, 1, kinds="int") == 1
    assert [value(scoring.action_weight, a) for a in ("like", "play", "skip", "other")] == [2.0, 1.0, -0.7, 0.0]


def test_periods(value):
    got = value(scoring.week_period, "Charts 28.12. - 03.01.2026", None)
    assert got is not None
    got = value(scoring.week_period, "28.12 - 03.01.2026", None)
    assert (str(got["start"]), str(got["end"])) == ("2025-12-28", "2026-01-03")
    assert value(scoring.week_period, "no dates", None)["start"] is None
    assert [value(scoring.movement_direction, u) for u in ("/i/arrow-up.png", "/i/down.gif?x", "/i/new.svg", "/i/x.png")] == ["up", "down", "new", None]
