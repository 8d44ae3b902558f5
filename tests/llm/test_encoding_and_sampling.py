"""BPE tries, importance resampling and fill-in-the-middle against plain versions and the tokenizers library."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.conftest import ASCII_LOWER
from tidechart.llm import bpe, importance
from tidechart.llm import fill_in_middle as fim


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# ---------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_file(bpe.default_tokenizer())))


def same_ids(encoder, library, texts):
    got = bpe.encode_texts(encoder, texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:80]


def test_encodings_of_every_code_point(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}{c}1" for c in points[i : i + 500]) for i in range(0, 0x32000, 500)]
    same_ids(encoder, library, texts + ["".join(points[i : i + 5000]) for i in range(0x32000, len(points), 5000)])


def test_encodings_of_random_and_adversarial_texts(encoder, library):
    rng = random.Random(4)
    letters = ["a", "b", "e", "t", " ", "  ", "\n", "'s", "'ll", "1", "99", "é", "ß", "中", "🙂", "-", "--", "=", "\t", " ", "<|endoftext|>", "<|endoftext", "ing", "The", "\x1c", "\x85"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * n for n in (1, 2, 3, 5, 50, 999)] + ["ab" * 700, "-" * 1000, " " * 1000 + "x", "=" * 777, "x" * 20000, "Aa1" * 3000, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> a"]
    same_ids(encoder, library, texts)


def test_encodings_of_documents(encoder, library, docs):
    same_ids(encoder, library, [r.text or "" for r in docs.select("text").collect()])


def test_shared_prefixes_are_worked_out_once(encoder):
    own = bpe.Encoder(encoder.v)
    words = {"there", "therefore", "thereby", "then", "the", " the"}
    own.learn(words)
    steps = []

    class Counted(dict):
        def get(self, key):
            steps.append(key)
            return super().get(key)

    own.moves, own.known = Counted(own.moves), {}
    own.learn(words)
    # one state for each distinct start of a word
    assert len(steps) == len({w.encode()[:i] for w in words for i in range(1, len(w.encode()) + 1)})
    for w in words:
        assert np.frombuffer(own.known[w], "<u4").tolist() == own.v.merged(w.encode())


def test_bounds_of_a_task_do_not_change_encodings(encoder, library, docs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 2000)
    monkeypatch.setattr(bpe, "TRIE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    own = bpe.Encoder(encoder.v)
    for r in docs.select("text").limit(40).collect():
        same_ids(own, library, [r.text or ""])


def test_bpe_frames(spark, odd, empty, library):
    path = bpe.default_tokenizer()
    more = odd.unionByName(spark.createDataFrame([(90, "a<|endoftext|>b " + "long text " * 150_000)], "doc_id long, text string"), allowMissingColumns=True)
    got = bpe.encoded(more).withColumn("text", bpe.decoder(spark, path)("ids")).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in more.select("doc_id", "text").collect()]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r.id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got) and bpe.encoded(empty).count() == 0


def test_decoding_of_broken_bytes(spark, library):
    lists = [[], [50256], [128, 222], [50256, 200, 15], [255, 254, 40]]
    packed = [(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)]
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in packed], "i int, ids binary").withColumn("t", bpe.decoder(spark, bpe.default_tokenizer())("ids")).orderBy("i").collect()
    assert [r.t for r in got] == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_bpe_query(spark, small, library, docs):
    got = {r.doc_id: r for r in bpe.op11_bpe(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        own = got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.tokenizer_file(public_tokenizers.path("word_bpe_49k.json")))


# ---------------------------------------------------------------- importance resampling
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text, max_n):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, max_n, buckets, min_words, share, seed):
    """docs: (uid, id, text). {uid: (n_words, n_features, weight, score, rank)}"""
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [d[2] for d in docs]), (t, target)):
        for text in texts:
            for f in plain_runs(text, max_n)[1]:
                counts[crc(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out, keys = {}, []
    for uid, own, text in docs:
        w, f = plain_runs(text, max_n)
        weight = sum(gain[crc(x)] for x in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if own is None else own}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[uid] = [len(w), len(f), weight, score, None]
        if len(w) >= min_words:
            keys.append((-score, own is None, own or 0, uid))
    for rank, key in enumerate(sorted(keys)[: share * len(keys) // 100], 1):
        out[key[3]][4] = rank
    return out


@pytest.mark.parametrize("max_n,buckets,min_words,share", [(1, 10_000, 20, 10), (1, 7, 1, 55), (3, 500, 2, 100), (2, 64, 0, 1)])
def test_resampling_against_a_plain_version(spark, odd, max_n, buckets, min_words, share):
    numbered = spark.createDataFrame([(i, t) for i, t in enumerate(["the same text", None, "word word two", "", "Ünïcödé end"])], "doc_id long, text string")
    got = importance.resampled(odd, numbered, max_n=max_n, buckets=buckets, min_words=min_words, share=share).collect()
    texts = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    assert len(got) == odd.count() and len({r.uid for r in got}) == len(got)
    # rows of one id have one text each, but for the null ids
    by_id = {i: t for i, t in texts if i is not None}
    words = {len(plain_runs(t, 1)[0]): t for i, t in texts if i is None}
    docs = [(r.uid, r.id, by_id[r.id] if r.id is not None else words[r.n_words]) for r in got]
    want = plain_resample(docs, [r.text for r in numbered.collect()], max_n, buckets, min_words, share, 2024)
    assert {r.uid: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got} == want


def test_resampling_empty(spark, empty, odd):
    assert importance.resampled(empty, empty).count() == 0
    assert importance.resampled(odd, empty, share=50).where("rank is not null").count() == sum(r.n_words >= 20 for r in importance.resampled(odd, empty).collect()) // 2


def test_registers_of_crc():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 2500, 300)
    end = start + rng.choice([0, 1, 2, 3, 8, 63, 64, 65, 2000], 300)
    got = importance.crc_on(np.full(300, 0xFFFFFFFF, np.uint32), data, start, end) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(importance.crc_on(np.zeros(0, np.uint32), data, np.zeros(0, int), np.zeros(0, int))) == 0


def test_runs_in_pieces_of_any_size(monkeypatch):
    texts = ["One two", None, "", "three-four FIVE", "ß é", "x" * 300, " ".join(f"w{i}" for i in range(400))]
    want = [sorted(zlib.crc32(f.encode()) % 997 for f in plain_runs(t, 3)[1]) for t in texts]
    for limit in (1, 20, 1 << 20):
        monkeypatch.setattr(importance, "PIECE_BYTES", limit)
        got = [[] for _ in texts]
        for first, _, _, runs in importance.hashed_runs(pa.array(texts), 3, 997):
            for doc, bucket in runs:
                for d, b in zip(doc, bucket):
                    got[first + d].append(b)
        assert [sorted(g) for g in got] == want


def test_selection_of_every_place(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(-3, 3), rng.choice([1, 2, importance.LAST]), i) for i in range(97)]
    spark.createDataFrame(rows, "k1 long, k2 long, k3 long").repartition(5).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    for k in (1, 2, 40, 96, 97):
        assert importance.kth_key(keys, k) == sorted(rows)[k - 1]
        assert {r.uid: r["rank"] for r in importance.first_k(keys, k).collect()} == {key[2]: i for i, key in enumerate(sorted(rows)[:k], 1)}
    assert importance.first_k(keys, 0).count() == 0


def test_a_quarter_goes_in_every_round():
    rng = np.random.default_rng(3)
    for _ in range(50):
        parts = [np.sort(rng.integers(0, 10**6, rng.integers(1, 400))) for _ in range(rng.integers(1, 9))]
        pivot = importance.weighted_median([(len(p), (int(p[(len(p) - 1) // 2]), 0, 0)) for p in parts])[0]
        everything = np.concatenate(parts)
        assert (everything <= pivot).sum() * 4 >= len(everything) and (everything >= pivot).sum() * 4 >= len(everything)


# ---------------------------------------------------------------- fill in the middle
def plain_fim(doc_id, text):
    text = text or ""
    units = regex.findall(fim.UNIT, text)
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


def check_fim(df):
    rows = df.select("doc_id", "text").collect()
    done = fim.transformed(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(*plain_fim(r.doc_id, r.text), r.text or "") for r in rows]
    assert sorted(map(tuple, done), key=repr) == sorted(want, key=repr)


def test_fim_odd(spark, odd, empty):
    check_fim(odd)
    assert fim.transformed(empty).count() == 0
    texts = ["<P> held", "a <S", "<", " <", "\x00 \x85 a b", "🙂 🙂🙂 é", "no end ", " \n x \x0b\x0c y\t", "S> <P <M>", "<<<S x y", "a\\E b \\Q"]
    check_fim(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string"))


def test_fim_documents(spark, docs):
    check_fim(docs)
    forms = {r.form: r["count"] for r in fim.transformed(docs).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["spm"] > forms["psm"]


def test_fim_very_long(spark):
    long = "word  and\n" * 400_000 + " " * 300_000
    check_fim(spark.createDataFrame([(i, long + str(i)) for i in range(4)], "doc_id long, text string"))


def test_other_sentinels_and_shares(spark, docs):
    marks = ("<|p|>", "(s)", "[m]+")
    done = fim.transformed(docs, seed=7, share=100, spm_share=0, sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    assert done.where("form = 'spm'").count() == 0
    assert done.join(docs, F.col("id") == F.col("doc_id")).where(F.col("back") != F.coalesce("text", F.lit(""))).count() == 0
