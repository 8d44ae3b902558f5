"""Extraction, language model, mixing, sharding, neighbours, toxicity and the pipeline."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ASCII_LOWER
from tidechart.llm import language_model as lm
from tidechart.llm import nearest, sharding, toxicity
from tidechart.llm.common import numbered
from tidechart.llm.boosting import calibrated, fit_isotonic, fit_trees
from tidechart.llm.crf import Crf, fit_crf, gradient
from tidechart.llm.html_extraction import _features, barred, blocks, extracted, labelled, main_text, op2_html_extraction, trained
from tidechart.llm.labelled_pages import training_pages
from tidechart.llm.mixing import mix, n_words, quality
from tidechart.llm.tokens import pieces


# ---------------------------------------------------------------- pages
def test_pages_of_the_table(spark, small):
    got = {r.page_id: r for r in op2_html_extraction(spark, small).collect()}
    import html

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_labelled_pages_that_training_lacks():
    model, right, total = trained(), 0, 0
    for parts in training_pages(80, seed=99):
        found, labels = labelled(parts)
        right += sum(a == b for a, b in zip(labels, model.decode(_features(found), barred(found)), strict=True))
        total += len(found)
    assert right / total > 0.995


STORY = "<h1>Title of it</h1><p>First one of the story is here.</p><p>And a second one follows it, longer than the first.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div id='wrap'>{STORY}</div><div id='nav'>Home About</div>",
        f"<table><tr><td>Home</td><td>{STORY}</td></tr></table>",
        f"<table><tr><td colspan=2><a href='/'>Site</a></td></tr><tr><td><p><a href=/a>One</a></p><p><a href=/b>Two</a></p></td><td>{STORY}</td></tr></table>",
        f"<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>{STORY}<div class='footer'>&copy; me</div>",
    ],
)
def test_pages_without_an_article_element(page):
    assert main_text(page, trained()) == "\n".join(re.findall(r"(?<=[>])[A-Z][^<]+(?=</h1>|</p>)", STORY))


LINES = ["Title of it", "First one of the story is here.", "And a second one follows it, longer than the first."]
END = "<p>And so it ends, they said.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<main>{STORY}<form><p>Sign up for our letter today.</p></form>{END}</main>",
        f"<article>{STORY}<form><p>Sign up for our letter today.</p></form>{END}</article>",
        f"<article>{STORY}{END}</article><div class='reactions'><p>Anna: great post!</p><p>Bob: I do not think so at all.</p></div>",
        f"<article>{STORY}{END}<ul class='thread'><li><cite>Ann</cite> I liked it.</li><li><cite>Bo</cite> So did I, very much.</li></ul></article>",
        f"<article>{STORY}{END}</article><ul class='thread'><li><cite>Ann</cite> I liked it.</li><li><cite>Bo</cite> So did I, very much.</li></ul>",
        f"<div id='wrap'>{STORY}{END}</div><div class='reactions'><p>Anna: great post!</p><p>Bob: I do not think so at all.</p></div>",
        f"<main>{STORY}<aside><p>Related: other stories you may like to read.</p></aside>{END}</main>",
        f"<article>{STORY}<div class='gads'>Buy now cheap shoes</div>{END}</article>",
        f"<form id='whole'><div id='nav'><a href=/>Home</a></div><div class='content'>{STORY}{END}</div></form>",
        f"<nav><form><p>Find it here</p></form></nav><article>{STORY}{END}</article><footer><p>One line of a footer, as long as others.</p></footer>",
    ],
)
def test_what_is_no_part_of_the_article_by_kind_or_form(page):
    assert main_text(f"<html><body>{page}</body></html>", trained()).split("\n") == [*LINES, "And so it ends, they said."]


@pytest.mark.parametrize("page", ["Just a page of text without any tags at all.", "Short text", "<html><body>Only some words in a body.</body></html>"])
def test_bare_text_is_the_article(page):
    assert main_text(page, trained()) == re.sub("<[^>]+>", "", page)


def test_barred_blocks_in_viterbi():
    rng = np.random.default_rng(5)
    for _ in range(40):
        model = Crf({f"f{i}": i for i in range(5)}, rng.normal(size=5), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
        items = [[f"f{i}" for i in range(6) if rng.random() < 0.5] for _ in range(rng.integers(1, 8))]
        barred = (rng.random(len(items)) < 0.4).tolist()
        allowed = [z for z in all_labels(len(items)) if not any(a and b for a, b in zip(z, barred))]
        assert model.decode(items, barred) == max(allowed, key=lambda z: log_score(model, items, z))


@pytest.mark.parametrize("unit", ["<a '", "<a '>' ", "<div>", "<", "<x><p>", "<!-- ", "<script>", "<div class='q'><li>", "<td><ul>", "&#", "<p title=\"'>"])
def test_broken_pages_are_read_in_linear_time(unit):
    trained()
    page = unit * (1_000_000 // len(unit)) + '"'
    began = time.time()
    main_text(page, trained())
    assert time.time() - began < 8


def test_words_of_the_article_outside_of_it_are_labelled_as_such():
    parts = [("<body><div class='ad'><p>Same words here.</p></div>", False), ("<p>Same words here.</p>", True), ("</body>", False)]
    found, labels = labelled(parts)
    assert [(b.text, z) for b, z in zip(found, labels)] == [("Same words here.", 0), ("Same words here.", 1)]


def all_labels(n):
    return [[i >> k & 1 for k in range(n)] for i in range(2**n)]


def log_score(model, items, labels):
    own = [sum(model.weight[model.index[f]] for f in item if f in model.index) * z for item, z in zip(items, labels)]
    moves = [model.move[a, b] for a, b in zip(labels, labels[1:])]
    return model.start[labels[0]] + sum(own) + sum(moves) + model.stop[labels[-1]]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        model = Crf({f"f{i}": i for i in range(5)}, rng.normal(size=5), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
        items = [[f"f{i}" for i in range(6) if rng.random() < 0.5] for _ in range(rng.integers(1, 8))]
        assert model.decode(items) == max(all_labels(len(items)), key=lambda z: log_score(model, items, z))


def test_gradient_against_differences():
    rng = np.random.default_rng(6)
    sequences = [([[f"f{i}" for i in range(4) if rng.random() < 0.6] or ["f0"] for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 3, 5)]
    index = {f"f{i}": i for i in range(4)}

    def loss(flat):
        model = Crf(index, flat[:4], flat[4:8].reshape(2, 2), flat[8:10], flat[10:12])
        total = sum(np.logaddexp.reduce([log_score(model, x, z) for z in all_labels(len(y))]) - log_score(model, x, y) for x, y in sequences)
        return total / len(sequences) + 0.5 * 2e-3 * (flat**2).sum()

    at = rng.normal(size=12)
    told = gradient(sequences, index, [at[:4], at[4:8].reshape(2, 2), at[8:10], at[10:12]], 2e-3)
    step = 1e-6 * np.eye(12)
    assert np.allclose(np.concatenate([g.ravel() for g in told]), [(loss(at + d) - loss(at - d)) / 2e-6 for d in step], atol=1e-4)


def test_page_parts():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site for many reasons.</p></div>
    <article><h1>A  title &amp; more</h1><p>First paragraph, long enough to tell that it is one.<p>Second &lt;b&gt; with
    <i>inline</i> markup&hellip; and x&#233;.<script>var a = "</p>";</script><div class="ad">Buy now things here.</div><p>Third one ends it.</article>
    <section id="comments"><div class="comment"><p>I liked this very much, said a reader of it.</p></div></section><form><label>Mail</label></form>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page, trained()) == "A title & more\nFirst paragraph, long enough to tell that it is one.\nSecond <b> with inline markup… and xé.\nThird one ends it."


def test_pages_odd(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>broken <b <i> & text"), (4, "u", "<" * 5000), (5, "u", "<div>" * 3000), (6, "u", "<article><p>" + "long text here. " * 20000 + "</p></article>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, id int, text string")
    got = extracted(df, trained()).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert {r.id: r.text for r in got}[6] == ("long text here. " * 20000).strip()
    assert extracted(df.limit(0), trained()).count() == 0


# ---------------------------------------------------------------- language model
def check_base(df, may_train):
    rows = df.select("doc_id", "text").collect()
    tokens = [(r.doc_id, [*(r.text or "").translate(ASCII_LOWER).encode().split(), None]) for r in rows]
    c = Counter(w for d, t in tokens if may_train(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for d, t in tokens)
    got = lm.scored(df, ~lm.held_out()).cache()
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.collect()) == want
    return got


def test_language_model(docs):
    got = check_base(docs, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    told = got.where(lm.held_out()).agg(F.sum("score"), F.sum("base_score")).first()
    assert told[0] > told[1]


def test_language_model_odd(odd, empty):
    got = check_base(odd, lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1)
    assert got.where("score > 0 or score is null").count() == 0
    assert lm.scored(empty, ~lm.held_out()).count() == 0


def test_language_model_without_training_rows(odd):
    got = lm.scored(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got)


@pytest.fixture(scope="module")
def language(spark, docs):
    """Rows, stored counts, vocabulary and model of the training documents."""
    rows = numbered(docs)
    training = rows.where(~lm.held_out())
    counts = lm.word_counts(training).cache()
    vocab = lm.vocabulary(counts, training.count())
    return rows, counts, vocab, lm.trained(training, vocab)


def test_probabilities_sum_to_one(language):
    """Over all words with vectors, the end, each group's counted words, and the words that training lacks."""
    _, counts, vocab, model = language
    frequent = set(vocab.words.tolist())
    tail = [(r.part, r.c) for r in counts.collect() if r.word % (1 << 64) not in frequent]
    of_group = np.zeros(lm.GROUPS)
    for g in range(lm.GROUPS):
        own = np.array([c for part, c in tail if part == g] + [0])
        of_group[g] = np.exp(lm.log_rare(vocab, np.full(len(own), g), own)).sum()
    assert np.allclose(of_group, 1) and len(tail) > 100
    everything = np.arange(vocab.symbols)
    for one, two in [(vocab.end, vocab.end), (0, vocab.end), (5, 0), (vocab.n_words + 3, 7), (vocab.n_words - 1, vocab.n_words)]:
        p = np.exp(model.log_p(vocab, everything, np.full(vocab.symbols, one), np.full(vocab.symbols, two)))
        p[vocab.n_words : vocab.end] *= of_group
        assert abs(p.sum() - 1) < 1e-4


def test_scores_against_a_plain_version(language):
    rows, counts, vocab, model = language
    count = {r.word % (1 << 64): r.c for r in counts.collect()}
    symbol = dict(zip(vocab.words.tolist(), vocab.place.tolist()))
    got = {r.uid: r.score for r in lm.scores(rows, counts, vocab, model).collect()}
    cls, first = vocab.cls.tolist(), vocab.first.tolist()
    soft = lambda x, i: x[i] - np.logaddexp.reduce(x)
    f8 = lambda x: x.astype(float)
    for r in rows.where("uid % 20 = 3").collect():
        p = next(iter(pieces(pa.array([r.text]), lower=True)))
        total, one, two = 0.0, vocab.end, vocab.end
        for h, group in [*zip(p.hash.tolist(), lm._group(p).tolist()), (None, None)]:
            s = vocab.end if h is None else symbol.get(h, vocab.n_words + group)
            q = f8(model.context[one]) * model.place[0] + f8(model.context[two]) * model.place[1]
            lo, hi = first[cls[s]], first[cls[s] + 1]
            total += soft(f8(model.target) @ q + model.bias, cls[s]) + soft(f8(model.word[lo:hi, : lm.SIZE]) @ q + model.word[lo:hi, lm.SIZE], s - lo)
            if vocab.n_words <= s < vocab.end:
                g, c = s - vocab.n_words, count.get(h, 0)
                tokens = max(vocab.rare[g], 1)
                share = (c - vocab.discount) / tokens if c else vocab.discount * vocab.rare_types[g] / tokens if vocab.rare[g] else 1.0
                total += np.log(share)
            one, two = s, one
        assert got[r.uid] == pytest.approx(total / np.log(10), rel=1e-4, abs=1e-3)


def test_vocabulary_grows_with_the_tokens(language, spark):
    _, counts, vocab, _ = language
    assert vocab.n_words == round(lm.ROOT * vocab.tokens**0.5) > lm.LEAST
    assert np.diff(vocab.first).max() < 12 * vocab.n_words**0.5 and len(vocab.mass) < 2 * vocab.n_words**0.5 + lm.GROUPS
    more = lm.vocabulary(counts.withColumn("c", F.col("c") * 4), 4 * vocab.ends)
    assert more.n_words == pytest.approx(2 * vocab.n_words, abs=2)


# ---------------------------------------------------------------- mixing
def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return {**out, **{s: left * w[s] / total for s in open_}}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
            left -= out[s]


def check_mix(df):
    got = mix(df, n_words(F.col("text")), quality(F.col("text"))).cache()
    rows = got.collect()
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = plain_targets(dict(size))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert len(rows) == df.count()
    again = mix(df.repartition(3), n_words(F.col("text")), quality(F.col("text")))
    assert Counter((r.id, r.taken) for r in again.collect()) == Counter((r.id, r.taken) for r in rows)


def test_mix(docs):
    check_mix(docs)


def test_mix_in_buckets(docs, monkeypatch):
    monkeypatch.setattr("tidechart.llm.mixing.BUCKET_ROWS", 2)
    check_mix(docs)


def test_mix_odd(odd, empty):
    check_mix(odd)
    assert mix(empty, n_words(F.col("text")), quality(F.col("text"))).count() == 0


# ---------------------------------------------------------------- sharding
def test_min_cost_flow():
    flow = sharding.min_cost_flow([10, 5], [6, 9], [[0, 1], [1, 0]])
    assert [sum(r) for r in flow] == [10, 5] and [sum(c) for c in zip(*flow)] == [6, 9]
    assert sum(flow[i][j] * (i != j) for i in range(2) for j in range(2)) == 4
    rng = np.random.default_rng(0)
    for _ in range(20):  # equal sizes: staying is free, so the least cost is the excess
        s = rng.integers(0, 50, 5).tolist()
        cap = [sum(s) // 5 + (j < sum(s) % 5) for j in range(5)]
        flow = sharding.min_cost_flow(s, cap, [[int(i != j) for j in range(5)] for i in range(5)])
        assert sum(flow[i][j] for i in range(5) for j in range(5) if i != j) == sum(max(0, a - b) for a, b in zip(s, cap))


def test_blocks_follow_the_flow():
    """Moved bytes are the flow's optimum, up to a block for each pair; shards end within a block of each other."""
    rng = np.random.default_rng(4)
    for trial in range(30):
        n_old, shards = rng.integers(1, 12), int(rng.integers(2, 9))
        old, size = rng.integers(0, n_old, 3000), rng.integers(1, 2000, 3000)
        if trial % 3 == 0:
            size[rng.integers(0, 3000, 5)] = 60_000
        new = sharding.assign_blocks(old, size, shards)
        load = np.bincount(new, size, shards)
        total = int(size.sum())
        capacity = [total // shards + (j < total % shards) for j in range(shards)]
        supply = np.bincount(old, size, max(n_old, shards)).astype(int)
        least = sum(max(0, supply[j] - capacity[j]) for j in range(shards)) + sum(supply[shards:])
        moved = size[old != new].sum()
        assert abs(moved - least) <= n_old * shards * 60, "small blocks come last, so no pair is off by much"
        assert load.max() - load.min() <= 2 * size.min() + 200


def check_shards(df, even=True):
    laid = sharding.laid_out(df)
    rows = sharding.reshard(laid, F.col(sharding.LAYOUT)).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
    assert Counter((r.id, r.size, r.text_crc32) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    load = [sum(r.size for r in by[j]) for j in range(8)]
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by) <= set(range(8))
    if even:
        assert max(load) - min(load) <= 0.01 * sum(load) / 8 + 100
    return rows


def test_shards(docs):
    rows = check_shards(docs)
    old, total = Counter(), sum(r.size for r in rows)
    for r in rows:
        old[r.old_shard] += r.size
    least = sum(max(0, n - total / 8) for n in old.values())
    moved = sum(r.size for r in rows if r.old_shard != r.shard)
    largest = max(r.size for r in rows)
    assert least - largest * 8 <= moved <= least + largest * 8
    at, times = defaultdict(set), Counter((r.size, r.text_crc32) for r in rows)
    for r in rows:
        at[r.size, r.text_crc32].add(r.shard)
    assert all(len(at[k]) == 1 for k, n in times.items() if n * k[0] <= total / 8 / sharding.SPLIT), "copies stay together"


def test_shards_odd(odd, empty):
    check_shards(odd, even=False)
    assert sharding.reshard(empty, sharding.by_text(6)).count() == 0


def test_hot_text_is_split(spark):
    df = spark.createDataFrame([(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)], "doc_id long, text string")
    check_shards(df)


def test_rows_without_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 100)
    df = spark.createDataFrame([(None if i % 3 else i, "hot " * 50 if i % 2 else f"text {i} " * 20) for i in range(3000)], "doc_id long, text string").repartition(4)
    rows = check_shards(df)
    hot = Counter(r.shard for r in rows if r.id is None and r.size == 201)
    assert len(hot) == 8 and max(hot.values()) < 2 * min(hot.values())


def test_rewrite_keeps_columns_of_any_name(spark, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(i, f"t {i} " * (1 + i % 40), i, "s", "b", "h", i % 2) for i in range(800)]
    names = "doc_id long, text string, sub int, before string, hot string, size string, shard int"
    spark.createDataFrame(rows, names).write.partitionBy("shard").parquet(path)
    sharding.rewrite(spark.read.parquet(path), F.col("shard"), path, 3)
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.drop("shard").collect())) == sorted(r[:-1] for r in rows)
    load = [r.s for r in got.groupBy("shard").agg(F.sum(F.length("text") + 1).alias("s")).collect()]
    assert len(load) == 3 and max(load) - min(load) < 0.05 * max(load)


def test_only_affected_shards_are_rewritten(docs, tmp_path):
    done = sharding.rewrite(docs, sharding.by_text(8), str(tmp_path / "out"))
    got = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in got.select("shard").distinct().collect()} == set(done)


def test_rewrite_of_a_layout_in_place(spark, tmp_path):
    path = str(tmp_path / "layout")
    # shards 0 and 1 are even, 2 is too large, 3 is missing and 6 has to go
    rows = [(n * 1000 + i, f"t{n} {i:04d} " + "x" * 91, n) for n, count in ((0, 200), (1, 200), (2, 300), (6, 100)) for i in range(count)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(1).write.partitionBy("shard").parquet(path)
    files = lambda n: {f.name for f in (tmp_path / "layout" / f"shard={n}").glob("*.parquet")}
    before = {n: files(n) for n in range(8)}
    layout = spark.read.parquet(path)
    placed = sharding.reshard(layout, F.col("shard"), 4).select("id", "old_shard", "shard").toPandas()
    moves = placed[placed["old_shard"] != placed["shard"]]
    touched = set(moves["old_shard"]) | set(moves["shard"])
    done = sharding.rewrite(layout, F.col("shard"), path, 4)
    assert set(done) == touched & set(range(4)) and {0, 1} - touched, "the case has shards that stay"
    for n in {0, 1} - touched:
        assert files(n) == before[n]
    for n in done:
        assert files(n) and not files(n) & before[n]
    assert not (tmp_path / "layout" / "shard=6").exists()
    got = spark.read.parquet(path)
    assert got.columns == ["doc_id", "text", "shard"]
    assert {(r.doc_id, r.shard) for r in got.collect()} == set(placed[["id", "shard"]].itertuples(index=False, name=None))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(r[:2] for r in rows)



# ---------------------------------------------------------------- neighbours
def drawn(kind, n, d=64):
    """Vectors that are hard to search: without clusters, a third of them equal, or of very unequal length."""
    rng = np.random.default_rng(17)
    v = rng.normal(size=(n, d))
    if kind == "a third equal":
        v[rng.random(n) < 1 / 3] = v[0]
    if kind == "log-normal lengths":
        v *= np.exp(rng.normal(size=(n, 1)))
    if kind == "one long":
        v[7] *= 1e4
    if kind == "far apart":
        v[: n // 2] *= 1e-200
        v[7] *= 1e200
    return v


def exact(v, ids, q, k=20):
    score = v @ v[ids == q][0]
    score[ids == q] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]]


@pytest.mark.parametrize("kind", ["gaussian", "a third equal", "log-normal lengths"])
def test_recall_of_a_graph(kind):
    v = drawn(kind, 6000)
    ids = np.arange(len(v))
    distinct, first, node = nearest._distinct(v, ids)
    graph = nearest.build(nearest._lifted(distinct), first)
    asked = ids[::20]
    r, own, _ = nearest.answers(graph, distinct, ids, node, v[asked], asked, 20)
    assert np.mean([len(set(exact(v, ids, q)) & set(own[r == i])) / 20 for i, q in enumerate(asked)]) >= 0.97


@pytest.mark.parametrize("kind, shards", [("a third equal", 3), ("log-normal lengths", 3), ("one long", 2), ("far apart", 2), ("gaussian", 8), ("gaussian", 28)])
def test_recall_over_shards(spark, kind, shards):
    v = drawn(kind, 8000, 32)
    ids = np.arange(len(v)) * 3 + (1 << 60)
    ids -= ids[0] % 60
    df = nearest.usable(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(4))
    got = nearest.neighbours(df, df.where("id % 60 = 0"), shards=shards).toPandas()
    hits = [len(set(exact(v, ids, q)) & set(own["id"])) / 20 for q, own in got.groupby("query_id")]
    assert len(hits) == (ids % 60 == 0).sum() and np.mean(hits) >= 0.97


def test_equal_vectors_are_one_node():
    v = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, -0.0], [1.0, 0.0]])
    distinct, first, node = nearest._distinct(v, np.array([3, 5, 8, 9]))
    assert distinct.tolist() == [[1.0, 0.0], [0.0, 2.0]] and first.tolist() == [3, 5] and node.tolist() == [0, 1, 0, 0]


def test_neighbours(spark, small):
    vectors = nearest.usable(spark.read.parquet(f"{small}/embeddings.parquet"))
    pdf = vectors.toPandas()
    v, ids = np.stack(pdf["v"].to_list()), pdf["id"].to_numpy()
    got = nearest.neighbours(vectors, vectors.where("id % 20 = 0"), shards=2).toPandas()
    hits = []
    for q, own in got.sort_values("rank").groupby("query_id"):
        score = v @ v[ids == q][0]
        hits.append(len(set(exact(v, ids, q)) & set(own["id"])) / 20)
        assert list(own["rank"]) == list(range(1, len(own) + 1)) and len(own) == 20
        assert np.allclose(own["score"], [score[ids == i][0] for i in own["id"]], atol=1e-12)
    assert np.mean(hits) >= 0.9 and len(hits) == (ids % 20 == 0).sum()


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 3.0]), (21, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, v string")
    own = nearest.usable(df)
    got = nearest.neighbours(own, own.where("id % 20 = 0"))
    assert [tuple(r)[1:] for r in got.where("query_id = 0").orderBy("rank").collect()] == [(1, 2, 2.0), (2, 1, 1.0), (3, 21, 1.0), (4, 20, 0.0)]
    assert nearest.neighbours(own.limit(0), own.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity
def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    m = fit_trees(x[:2000], y[:2000])
    p = calibrated(m.margin(x[2000:]), fit_isotonic(m.margin(x[:2000]), y[:2000]))
    assert ((p > 0.5) == (y[2000:] > 0.5)).mean() > 0.97
    order = np.argsort(m.margin(x[2000:]))
    assert (np.diff(p[order]) >= -1e-9).all()


def plain_tree_margin(model, row):
    out = model.base
    for feature, split, leaf in zip(model.feature, model.split, model.leaf):
        node = 0
        for _ in range(model.depth):
            edges = model.edges[feature[node]]
            node = 2 * node + 1 + int(sum(e < row[feature[node]] for e in edges) > split[node])
        out += leaf[node - (2**model.depth - 1)]
    return out


def test_trees_against_a_plain_version():
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = fit_trees(x, y, trees=10)
    assert np.allclose(model.margin(x[:50]), [plain_tree_margin(model, row) for row in x[:50]])
    # the first split is the best of all features and places
    g, h = y.mean() - y, np.full(len(y), y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max(gain(x[:, j] <= e) for j in range(3) for e in model.edges[j])
    f, s = model.feature[0][0], model.split[0][0]
    assert gain(x[:, f] <= model.edges[f][s]) == pytest.approx(best)


def test_isotonic_fit_against_a_plain_version():
    rng = np.random.default_rng(13)
    score, y = rng.normal(size=200), (rng.random(200) < 0.4).astype(float)
    at, p = fit_isotonic(score, y)
    assert (np.diff(p) >= 0).all() and (np.diff(at) > 0).all() and p.min() > 0 and p.max() < 1
    order = np.argsort(score)
    # the greatest of lowest means to the right: the least-squares fit that never falls
    own = y[order]
    fit = [max(min(own[i:j].mean() for j in range(k + 1, len(own) + 1)) for i in range(k + 1)) for k in range(len(own))]
    assert np.abs(np.interp(score[order], at, p) - fit).mean() < 0.05


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_of_documents_held_out(spark):
    at = "/root/testdata/sf0.01"
    got = toxicity.op9_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.97
    y, p = got["toxic"].to_numpy(), got["predicted"].to_numpy()
    assert p[y == 1].mean() > 0.85 and y[p == 1].mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_toxicity_odd(odd, empty, spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (4, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.trained(odd, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.trained(odd, labels.limit(0))
    assert {round(r.score, 3) for r in toxicity.scored(odd, none).collect()} == {0.5}
    kept = toxicity.accepted(odd, model)
    assert kept.schema == odd.schema


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, small).cache()
        if name == "sharding":
            assert docs.count() == before.count()
            continue
        assert docs.columns == names
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or name == "mixing"
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_odd(spark, odd, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "w120 w121 w122 w123 w124 w125 w126 w127 w128 w129")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.count()
    left = corpus_pipeline.decontamination(spark, odd, sf)
    assert left.where("text like '%w120 w121 w122%'").count() == 0 and left.count() == odd.count() - 3
    assert corpus_pipeline.ngram_jaccard(spark, odd, sf).where("text is null").count() == odd.where("text is null").count()
