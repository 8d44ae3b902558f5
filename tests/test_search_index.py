"""Substring search through the index of letter runs against a plain search."""

from datetime import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidechart.plans import search_index, serving

SCHEMA = "key long, text string, score double, q string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aabcdé ") for _ in range(rng.randint(0, 9))).strip().replace("é", "e")
    out = [(k, " ".join(word() for _ in range(rng.randint(0, 4))), rng.choice([None, 1.0, 2.0, rng.random()]), "x") for k in range(150)]
    # a repeated key, a null one, null and empty texts, letters outside the plane
    return out + [(3, "abcd again", 0.5, "x"), (None, "abcd", 0.1, "x"), (200, None, 9.0, "x"), (201, "", 8.0, "x"), (202, "\U0001d11e abc", 3.0, "x")]


@pytest.fixture(scope="module")
def catalog(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ASKED = ["a", "ab", "ÁBC", "abcd", "bc d", "aaaa", "zzz", "abz", "", "!!", "d a", "again"]


def told(df):
    return [(r.key, r.text, r.score) for r in df.collect()]


@pytest.mark.parametrize("q", ASKED)
def test_one_query(catalog, spark, tmp_path_factory, q):
    base = str(tmp_path_factory.mktemp("index"))
    if q == "abcd":
        search_index.publish_index(catalog, base, "catalog", "text", "key", "r1", datetime(2024, 1, 1))
        index = search_index.read_index(spark, base, "catalog")
    else:
        index = search_index.build_index(catalog, "text", "key")
    want = serving.search(catalog, q, "text", "score", "key", 30)
    assert told(search_index.search_indexed(catalog, index, q, "text", "score", "key", 30)) == told(want)


def test_many_queries(catalog, spark):
    own = catalog.drop("q").dropDuplicates(["key"])
    index = search_index.build_index(own, "text", "key")
    asked = spark.createDataFrame([(q,) for q in [*ASKED, "ab", None]], "q string")
    got = search_index.search_many(own, index, asked, "text", "score", "key", 7).orderBy("q", "rank").collect()
    for q in ASKED:
        mine = [(r.key, r.text, r.score) for r in got if r.q == q]
        assert mine == told(serving.search(own, q, "text", "score", "key", 7)), q
    assert {r.q for r in got} <= set(ASKED)


def test_empty(catalog, spark, tmp_path):
    none = catalog.limit(0)
    index = search_index.build_index(none, "text", "key")
    assert search_index.search_indexed(none, index, "abc", "text", "score", "key").count() == 0
    assert search_index.read_index(spark, str(tmp_path), "catalog") is None


def test_lists_read_are_those_of_the_query(catalog):
    index = search_index.build_index(catalog, "text", "key")
    found = search_index.search_indexed(catalog, index, "abcd", "text", "score", "key")
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(run,abc)" in plan and "EqualTo(run,bcd)" in plan
