"""Names in texts by their rarest word, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tidechart.operators import detection


def plain(texts, names, ctx):
    """(doc, code, start, end, lead, tail) of every place; texts and names are in normal form."""
    out = []
    for doc, text in texts:
        words = text.split(" ")
        for name, code in names:
            own = name.split(" ")
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    start = len(" ".join(words[:i])) + (i > 0)
                    end = start + len(name)
                    out.append((doc, code, start, end, text[max(0, start - ctx) : start], text[end : end + ctx]))
    return sorted(out)


def terms_of(spark, names):
    return detection.aliases(spark.createDataFrame(names, "name string, code string"), "name", "code", [])


@pytest.mark.parametrize("stride,ctx", [(256, 30), (4, 3)])
def test_matches_against_a_plain_search(spark, monkeypatch, stride, ctx):
    monkeypatch.setattr(detection, "STRIDE", stride)
    rng = random.Random(stride)
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "eee"]) for _ in range(rng.choice([1, 2, 9, 60, 700])))) for i in range(40)]
    # names that overlap themselves and each other, share words, have several codes, or stand nowhere
    names = [("a", "A"), ("a b a", "ABA"), ("b a", "BA"), ("dd dd", "DD"), ("a a a", "AAA"), ("b a", "BA2"), ("eee c b a dd", "L"), ("zz", "Z"), ("a zz", "AZ")]
    got = detection.term_matches(spark.createDataFrame(texts, "doc int, text string"), "doc", "text", terms_of(spark, names), ctx)
    assert got.columns == ["doc", "code", "start", "end", "lead", "tail"]
    assert sorted(tuple(r) for r in got.collect()) == plain(texts, names, ctx)


def test_given_counts_change_nothing(spark):
    texts = spark.createDataFrame([(1, "the end of the road"), (2, None), (3, ""), (4, "!!"), (5, "Of The End")], "doc int, text string")
    terms = terms_of(spark, [("of the", "OT"), ("the end", "TE")])
    key = lambda df: sorted((r.doc, r.code, r.start) for r in df.collect())
    want = [(1, "OT", 8), (1, "TE", 0), (5, "OT", 0), (5, "TE", 3)]
    assert key(detection.term_matches(texts, "doc", "text", terms)) == want
    skewed = detection.word_counts(texts, "doc", "text").withColumn("n", 100 - F.col("n"))
    assert key(detection.term_matches(texts, "doc", "text", terms, counts=skewed)) == want
    assert detection.term_matches(texts.limit(0), "doc", "text", terms).count() == 0
    assert detection.term_matches(texts, "doc", "text", terms.limit(0)).count() == 0


def test_a_hot_word_costs_nothing(spark):
    """A thousand names share a word that stands everywhere; each is looked for by its other word."""
    texts = spark.range(200).select(F.col("id").alias("doc"), F.concat(F.lit("city "), F.expr("repeat('city ', 20)"), F.concat(F.lit("n"), F.col("id"))).alias("text"))
    terms = terms_of(spark, [(f"city n{i}", str(i)) for i in range(1000)])
    named = detection.anchors(terms, detection.word_counts(texts, "doc", "text"))
    assert {r.word for r in named.collect()} == {f"n{i}" for i in range(200)}
    assert detection.term_matches(texts, "doc", "text", terms).count() == 200


def test_long_texts(spark):
    n = 120_000
    text = "x " * n + "far end"
    got = detection.term_matches(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text", terms_of(spark, [("far end", "F")])).collect()
    assert [(r.start, r.end, r.lead, r.tail) for r in got] == [(2 * n, 2 * n + 7, "x " * 15, "")]
