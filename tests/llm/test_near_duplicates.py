"""The near-duplicate stage of the pipeline: five-word shingles, similarity of 0.8 or more."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import plain_components
from tidechart.llm.common import numbered
from tidechart.llm.jaccard_join import _meetings, distinct_sets, joined


def _word(rng):
    return lambda n: [f"q{x}" for x in rng.integers(0, 10**9, n)]


def _similarity(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def plain_kept(texts, k, least):
    """The first text of each component of pairs from a similarity of `least`, pair by pair."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sorted((find(i), find(j)))
            if a != b and _similarity(texts[i], texts[j], k) >= least - 1e-12:
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_stage_drops_copies_between_eight_and_nine_tenths(spark, small):
    word = _word(np.random.default_rng(21))
    long, short, other = word(100), word(50), word(48)
    texts = [
        " ".join(long), " ".join(long + word(15)),
        " ".join(short), " ".join(short[:25] + word(1) + short[26:]),
        " ".join(other), " ".join(other[:25] + word(1) + other[26:]),
    ]
    assert [round(_similarity(texts[i], texts[i + 1]), 3) for i in (0, 2, 4)] == [0.865, 0.804, 0.796]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, small).collect()}
    assert left == {0, 2, 4, 5}


@pytest.mark.parametrize("block", [4, 256])
def test_stage_families_around_its_threshold(spark, small, monkeypatch, block):
    import tidechart.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", block)
    rng = np.random.default_rng(22)
    word = _word(rng)
    line, texts = " ".join(word(12)), []
    for _ in range(5):
        base = word(100)
        for _ in range(20):
            copy = list(base)
            for at in rng.integers(0, 100, rng.integers(0, 5)):
                copy[at] = word(1)[0]
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(word(rng.integers(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, small).collect()}
    assert left == plain_kept(texts, 5, 0.8) != plain_kept(texts, 5, 0.9)


def test_threshold_is_a_parameter(spark):
    word = _word(np.random.default_rng(23))
    base = word(50)
    rows = [(0, " ".join(base)), (1, " ".join(base[:25] + word(1) + base[26:]))]
    own = numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in joined(own, 5, 8, 10).collect()} == {0}
    assert {(r.id, r.n_shingles, r.component_id) for r in joined(own).collect()} == set(plain_components(rows))
    with pytest.raises(ValueError):
        joined(own, 5, 6, 10)


def test_sets_of_a_block_meet_by_rare_shingles():
    rng = np.random.default_rng(12)
    for num, den in ((9, 10), (8, 10)):
        base = rng.choice(10**6, 120, replace=False)
        sets_ = []
        for _ in range(60):
            kept = base[rng.random(120) > rng.choice([0.0, 0.05, 0.1, 0.4])]
            sets_.append(np.unique(np.concatenate([kept, rng.choice(10**6, rng.integers(0, 12))])))
        sets_ = sorted(sets_, key=len) + [np.array([7]), np.array([7])]
        met = _meetings(sets_, num, den)
        assert all((near > i).all() for i, near in enumerate(met))
        for i, a in enumerate(sets_):
            for j in range(i + 1, len(sets_)):
                common = len(np.intersect1d(a, sets_[j]))
                if common * den >= (len(a) + len(sets_[j]) - common) * num:
                    assert j in met[i]


def test_unlinked_members_of_a_family_do_not_meet():
    """Copies that each differ in a third of their shingles have too many of their own to link."""
    rng = np.random.default_rng(13)
    base = rng.choice(10**9, 300, replace=False)
    sets_ = [np.unique(np.concatenate([base[rng.random(300) > 0.3], rng.choice(10**9, 90)])) for _ in range(500)]
    assert sum(map(len, _meetings(sets_, 8, 10))) == 0


def test_sets_are_told_apart_by_both_hashes(spark):
    """Two sets with one hash are two, named by row numbers."""
    rows = [(1, 3, 5, 1, 1), (2, 3, 5, 2, 1), (3, 3, 5, 1, 1), (4, 0, 0, 0, 0)]
    named = distinct_sets(spark.createDataFrame(rows, "uid long, n long, hash long, hash2 long, n0 long"))
    assert sorted((r.sid, r.hash2) for r in named.collect()) == [(1, 1), (2, 2)]
