"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Counts of all words of the training texts are exact. The most frequent words, whose number grows with the square
root of the training tokens, have vectors of their own; the others stand in groups by their first letters, and the
end of a text is a symbol too. From the two symbols before a token comes q = c1 * r[s1] + c2 * r[s2]. A token's
probability is that of its class, softmax(q . t + b) over classes, times that of its word, softmax(q . u + d) over
the words of the class. Classes are runs of words by frequency with equal shares of the tokens, so both softmaxes
are about the square root of the vocabulary wide; each group and the end are classes of one. Within a group a word
has its discounted count's share; what discounting frees goes to words that training lacks.

Training: every task runs over all its training tokens in numpy (AdaGrad; noise for classes shared by a batch, noise
for words drawn in the token's class), and the tasks' vectors are averaged, each by how often the task has met its
word. At most TRAINERS tasks train. Scoring: both softmaxes come from batched matrix products, so token
log-probabilities sum to one.

Word counts reach the texts again by chunks of texts: each chunk's distinct words join the counts, return as
that chunk's small table, and meet the chunk's texts in one cogroup. A chunk has about CHUNK_BYTES of text.

Defined cases: a null or empty text is its end alone; without training texts all words are unknown; a null id
counts as training; of words with equal counts, the one of least hash is the more frequent; a very long text is a
piece of its own and scored whole; repeated rows are scored one by one; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import numbered, stored, table
from tidechart.llm.tokens import Piece, pieces

CHUNK_BYTES = 8 << 20
#: Words with vectors: this times the square root of the training tokens, LEAST at least.
ROOT, LEAST = 3.0, 256
GROUPS, SIZE = 64, 16
BATCH, NOISE, SAMPLES, WORD_NOISE, RATE, SCALE = 4096, 8, 32, 2, 0.1, 128.0
#: Tasks that train at most, and words whose vectors travel in one row.
TRAINERS, ROW_WORDS = 4096, 512
LOG10 = np.log(10.0)
I64 = np.int64
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def _group(p: Piece) -> np.ndarray:
    """The group of each word by its first two bytes."""
    one = _FOLD[p.data[p.start]]
    two = np.where(p.end - p.start > 1, _FOLD[p.data[np.minimum(p.start + 1, len(p.data) - 1)]], 0)
    return ((one * 167 + two * 59) >> 1) % GROUPS


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, part, c): counts of all words (by hash) of `rows` (text); part: the word's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(0), lower=True, limit=8 << 20):
                word, at, c = np.unique(p.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(I64)), pa.array(_group(p)[at].astype(np.int32)), pa.array(c)], names=["word", "part", "c"])

    return rows.select("text").mapInArrow(run, "word long, part int, c long").groupBy("word").agg(F.first("part").alias("part"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals of the training tokens, and the symbols: words by frequency, then groups, then the end.

    words, place: the words' hashes in order, and the symbol of each. cls: the class of each symbol. first: where
    each class's symbols begin. share: a symbol's share of its class; mass: a class's share of all tokens.
    """

    tokens: int
    types: int
    ends: int
    words: np.ndarray
    place: np.ndarray
    cls: np.ndarray
    first: np.ndarray
    share: np.ndarray
    mass: np.ndarray
    rare: np.ndarray
    rare_types: np.ndarray
    discount: float

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def symbols(self) -> int:
        return len(self.cls)

    @property
    def end(self) -> int:
        return len(self.cls) - 1

    def of(self, p: Piece) -> np.ndarray:
        """The symbol of each word."""
        if not len(p.hash):
            return np.zeros(0, I64)
        group = self.n_words + _group(p)
        if not self.n_words:
            return group
        i = np.minimum(np.searchsorted(self.words, p.hash), self.n_words - 1)
        return np.where(self.words[i] == p.hash, self.place[i], group)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Reduce stored counts to totals by group and the most frequent words."""
    of_part = [F.sum("c").alias("c"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")]
    by_part = counts.groupBy("part").agg(*of_part).toPandas()
    total = int(by_part["c"].sum()) + ends
    most = max(LEAST, round(ROOT * total**0.5))
    top = counts.orderBy(F.desc("c"), "word").limit(most).toPandas()
    n, part, c = len(top), top["part"].to_numpy(int), top["c"].to_numpy(float)
    rare, types = np.zeros(GROUPS), np.zeros(GROUPS)
    rare[by_part["part"].to_numpy(int)] = by_part["c"]
    types[by_part["part"].to_numpy(int)] = by_part["types"]
    np.subtract.at(rare, part, c)
    np.subtract.at(types, part, 1)
    # runs of words with equal shares of the tokens
    below = (np.cumsum(c) - c) / max(c.sum(), 1)
    run = np.floor(below * max(1, round(n**0.5))).astype(I64)
    cls = np.unique(run, return_inverse=True)[1].ravel() if n else np.zeros(0, I64)
    k = int(cls[-1]) + 1 if n else 0
    cls = np.concatenate([cls, np.arange(k, k + GROUPS + 1)])
    count = np.concatenate([c, rare, [ends]]) + 0.5
    mass = np.bincount(cls, count)
    ones, twos = float(by_part["ones"].sum()), float(by_part["twos"].sum())
    words = top["word"].to_numpy(I64).view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(
        total, int(by_part["types"].sum()) + (ends > 0), ends, words[order], order, cls, np.searchsorted(cls, np.arange(len(mass) + 1)),
        count / mass[cls], mass / mass.sum(), rare, types, float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9)),
    )


def sequence(p: Piece, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, one before, two before, document, place of each word) of all tokens with ends."""
    m, counts = p.last - p.first, p.counts
    at = np.arange(len(p.hash)) + p.doc
    out = np.full(len(p.hash) + m, end)
    out[at] = symbols
    doc = np.repeat(np.arange(m), counts + 1)
    place = np.arange(len(out)) - np.repeat(np.cumsum(counts + 1) - (counts + 1), counts + 1)
    one, two = np.full(len(out), end), np.full(len(out), end)
    one[1:], two[2:] = np.where(place[1:] >= 1, out[:-1], end), np.where(place[2:] >= 2, out[:-2], end)
    return out, one, two, doc, at


def log_sum_exp(s: np.ndarray) -> np.ndarray:
    """Of each row of scores, the log of the sum of exponentials. Overwrites the scores."""
    if not len(s):
        return np.zeros(0, np.float32)
    top = s.max(1) if s.max() > 60 or s.min() < -60 else np.zeros(1, np.float32)
    s -= top[:, None]
    np.exp(s, out=s)
    return top + np.log(s.sum(1))


@dataclass
class Bilinear:
    """Of symbols: context vectors, and target vectors with a bias behind, within their class. Of classes: targets, biases."""

    context: np.ndarray
    word: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    @classmethod
    def start(cls, vocab: Vocabulary) -> Bilinear:
        rng = np.random.default_rng(5)
        s, k = vocab.symbols, len(vocab.mass)
        draw = lambda n, d: rng.normal(0, d, (n, SIZE)).astype(np.float32)
        log = lambda x: np.log(x).astype(np.float32)
        word = np.concatenate([draw(s, 0.05), log(vocab.share)[:, None]], axis=1)
        return cls(draw(s, 0.3), word, draw(k, 0.05), log(vocab.mass), np.ones((2, SIZE), np.float32))

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.place[0] + self.context[two] * self.place[1]

    def log_word(self, q: np.ndarray, symbol: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P(symbol | class) of each row: rows of one class at a time, in blocks."""
        out = np.zeros(len(q), np.float32)
        todo = np.flatnonzero(np.diff(first)[cls] > 1)
        todo = todo[np.argsort(cls[todo], kind="stable")]
        kinds, begin = np.unique(cls[todo], return_index=True)
        for c, lo, hi in zip(kinds, begin, np.append(begin[1:], len(todo)), strict=False):
            u, d = self.word[first[c] : first[c + 1], :SIZE], self.word[first[c] : first[c + 1], SIZE]
            step = max(1, (1 << 20) // len(u))
            for at in range(lo, hi, step):
                rows = todo[at : min(at + step, hi)]
                s = q[rows] @ u.T
                s += d
                own = s[np.arange(len(rows)), symbol[rows] - first[c]]
                out[rows] = own - log_sum_exp(s)
        return out

    def log_p(self, vocab: Vocabulary, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of symbols after their contexts. Class normalisers are made once a context."""
        q, cls = self.hidden(one, two), vocab.cls[symbol]
        out = self.log_word(q, symbol, cls, vocab.first).astype(float)
        out += np.einsum("nd,nd->n", q, self.target[cls]) + self.bias[cls]
        _, first, of = np.unique(one.astype(I64) * vocab.symbols + two, return_index=True, return_inverse=True)
        total = np.empty(len(first))
        for lo in range(0, len(first), 8192):
            s = q[first[lo : lo + 8192]] @ self.target.T
            s += self.bias
            total[lo : lo + 8192] = log_sum_exp(s)
        return out - total[of.ravel()]


class Trainer:
    """Noise-contrastive AdaGrad steps on a model, in place."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.model, self.rng = vocab, Bilinear.start(vocab), np.random.default_rng(9)
        self.squares = {k: np.zeros_like(v) for k, v in vars(self.model).items()}
        self.log_class_noise = np.log(NOISE * vocab.mass).astype(np.float32)
        self.log_word_noise = np.log(WORD_NOISE * vocab.share).astype(np.float32)
        self.class_sum = np.cumsum(vocab.mass)
        self.many = np.diff(vocab.first)[vocab.cls] > 1
        self.word_sum = np.cumsum(vocab.share)
        self.seen, self.met = 0, np.zeros(vocab.symbols)

    def _dense(self, name: str, g: np.ndarray) -> None:
        x, s = getattr(self.model, name), self.squares[name]
        g = g / SCALE
        s += g * g
        x -= RATE * g / np.sqrt(s + 1e-3)

    def _sparse(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        """Add up the gradients of each row and step those rows."""
        if not len(rows):
            return
        x, s = getattr(self.model, name), self.squares[name]
        order = np.argsort(rows.astype(np.uint16) if len(x) < 1 << 16 else rows, kind="stable")
        own = rows[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at, g = own[begin], np.add.reduceat(g[order], begin, axis=0) / SCALE
        s[at] += g * g
        x[at] -= RATE * g / np.sqrt(s[at] + 1e-3)

    def step(self, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        m, v, rng = self.model, self.vocab, self.rng
        cls = v.cls[t]
        drawn = np.minimum(np.searchsorted(self.class_sum, rng.random(SAMPLES)), len(v.mass) - 1)
        ca, cb, tt, td = m.context[a], m.context[b], m.target[cls], m.target[drawn]
        q = ca * m.place[0] + cb * m.place[1]
        up = np.einsum("nd,nd->n", q, tt) + m.bias[cls] - self.log_class_noise[cls]
        down = q @ td.T + m.bias[drawn] - self.log_class_noise[drawn]
        g_up = -1 / (1 + np.exp(np.clip(up, -30, 30)))
        g_down = (NOISE / SAMPLES) / (1 + np.exp(np.clip(-down, -30, 30)))
        dq = g_up[:, None] * tt + g_down @ td
        k = len(v.mass)
        grad_t = np.stack([np.bincount(cls, g_up * q[:, j], k) for j in range(SIZE)], axis=1).astype(np.float32)
        grad_b = np.bincount(cls, g_up, k).astype(np.float32)
        np.add.at(grad_t, drawn, g_down.T @ q)
        np.add.at(grad_b, drawn, g_down.sum(0))
        # words against noise words of their class
        some = np.flatnonzero(self.many[t])
        lo = v.first[cls[some]]
        below = np.where(lo > 0, self.word_sum[lo - 1], 0.0)
        other = np.searchsorted(self.word_sum, below[:, None] + rng.random((len(some), WORD_NOISE)), side="right")
        other = np.clip(other, lo[:, None], v.first[cls[some] + 1][:, None] - 1)
        rows = np.concatenate([t[some], other.ravel()])
        qs = np.concatenate([q[some], np.repeat(q[some], WORD_NOISE, axis=0)])
        u = m.word[rows]
        score = np.einsum("nd,nd->n", qs, u[:, :SIZE]) + u[:, SIZE] - self.log_word_noise[rows]
        sign = np.ones(len(rows), np.float32)
        sign[: len(some)] = -1
        g = sign / (1 + np.exp(np.clip(-sign * score, -30, 30)))
        push = g[:, None] * u[:, :SIZE]
        dq[some] += push[: len(some)] + push[len(some) :].reshape(len(some), WORD_NOISE, SIZE).sum(1)
        self._sparse("word", rows, np.concatenate([g[:, None] * qs, g[:, None]], axis=1))
        self._sparse("context", np.concatenate([a, b]), np.concatenate([dq * m.place[0], dq * m.place[1]]))
        self._dense("place", np.stack([(dq * ca).sum(0), (dq * cb).sum(0)]))
        self._dense("target", grad_t)
        self._dense("bias", grad_b)

    def over(self, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(t), BATCH):
            part = slice(lo, lo + BATCH)
            self.step(t[part], a[part], b[part])
        self.seen += len(t)
        self.met += np.bincount(t, minlength=len(self.met))


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    """The mean of one row's vectors over trainers, each weighted by how often the trainer has met the word."""
    total, weight = None, None
    for v, w in zip(group["v"], group["w"], strict=True):
        w = np.frombuffer(w, np.float64)[:, None]
        x = np.frombuffer(v, np.float32).reshape(len(w), -1) * w
        total, weight = (x, w) if total is None else (total + x, weight + w)
    mean = (total / weight).astype(np.float32)
    return pd.DataFrame({"kind": [group["kind"].iat[0]], "i": [group["i"].iat[0]], "v": [mean.tobytes()]})


def trained(rows: DataFrame, vocab: Vocabulary) -> Bilinear:
    """Vectors averaged over tasks, each trained on all tokens of its part of `rows` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(vocab)
        for batch in batches:
            for p in pieces(batch.column(0), lower=True):
                w, one, two, _, _ = sequence(p, vocab.of(p), vocab.end)
                t.over(w, one, two)
        if not t.seen:
            return
        m = t.model
        words = np.concatenate([m.context, m.word], axis=1)
        rest = np.concatenate([m.target.ravel(), m.bias, m.place.ravel()])[None, :]
        out = [("word", i, words[i : i + ROW_WORDS], t.met[i : i + ROW_WORDS] + 1e-3) for i in range(0, len(words), ROW_WORDS)]
        out.append(("class", 0, rest, np.array([float(t.seen)])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([np.ascontiguousarray(o[2], np.float32).tobytes() for o in out], pa.binary()), pa.array([o[3].tobytes() for o in out], pa.binary())],
            names=["kind", "i", "v", "w"],
        )

    parts = rows.select("text").coalesce(TRAINERS).mapInArrow(run, "kind string, i long, v binary, w binary")
    mean = parts.groupBy("kind", "i").applyInPandas(_averaged, "kind string, i long, v binary").toPandas().sort_values(["kind", "i"])
    start = Bilinear.start(vocab)
    if not len(mean):
        return start
    of = lambda kind: np.concatenate([np.frombuffer(v, np.float32) for v in mean.loc[mean["kind"] == kind, "v"]])
    words, rest = of("word").reshape(vocab.symbols, -1), of("class")
    k = len(vocab.mass)
    target, bias, place = np.split(rest, [k * SIZE, k * SIZE + k])
    return Bilinear(words[:, :SIZE].copy(), words[:, SIZE:].copy(), target.reshape(k, SIZE), bias, place.reshape(2, SIZE))


def log_rare(vocab: Vocabulary, group: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log of a word's share of its group, by its count in training; 0 stands for all words that training lacks."""
    total = np.maximum(vocab.rare[group], 1)
    unseen = np.where(vocab.rare[group] > 0, vocab.discount * vocab.rare_types[group] / total, 1.0)
    return np.log(np.where(count > 0, (count - vocab.discount) / total, unseen))


def scored(docs: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    may_train: a condition on `id`.
    """
    rows = numbered(docs, id_col, text_col)
    training = rows.where(may_train)
    counts = stored(word_counts(training), "counts")
    vocab = vocabulary(counts, training.count())
    model = trained(training, vocab)
    return scores(rows, counts, vocab, model)


def scores(rows: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Bilinear) -> DataFrame:
    """As `scored`, of rows (uid, id, text) by a model. Texts are dealt to as many tasks as there are chunks."""
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk")
    chunked = rows.select(chunk, "uid", "text").repartition(chunks, "chunk")

    def distinct(group: pa.Table) -> pa.Table:
        own = group.column("chunk")[0].as_py()
        words = np.unique(np.concatenate([np.unique(p.hash) for c in group.column("text").chunks for p in pieces(c, lower=True)] or [np.zeros(0, np.uint64)]))
        return pa.table({"__chunk": pa.array(np.full(len(words), own, I64)), "word": pa.array(words.view(I64))})

    asked = chunked.groupBy("chunk").applyInArrow(distinct, "__chunk long, word long")
    answers = asked.join(counts.select("word", "c"), "word").select("__chunk", "word", "c")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        word, c = right.column("word").to_numpy().view(np.uint64), right.column("c").to_numpy()
        order = np.argsort(word)
        word, c = word[order], c[order]
        out: list[list[np.ndarray]] = []
        for column, uid in zip(left.column("text").chunks, left.column("uid").chunks, strict=True):
            ids = uid.to_numpy()
            for p in pieces(column, lower=True):
                m = p.last - p.first
                known = np.zeros(len(p.hash), I64)
                if len(word) and len(p.hash):
                    i = np.minimum(np.searchsorted(word, p.hash), len(word) - 1)
                    known = np.where(word[i] == p.hash, c[i], 0)
                symbol, one, two, doc, at = sequence(p, vocab.of(p), vocab.end)
                count = np.full(len(symbol), vocab.ends, I64)
                count[at] = known
                base = np.log10((count + 0.5) / (vocab.tokens + 0.5 * (vocab.types + 1)))
                log_p = model.log_p(vocab, symbol, one, two)
                rare = np.flatnonzero((symbol >= vocab.n_words) & (symbol < vocab.end))
                log_p[rare] += log_rare(vocab, symbol[rare] - vocab.n_words, count[rare])
                total_of = lambda v, doc=doc, m=m: np.bincount(doc, v, m)
                out.append([ids[p.first : p.last], p.counts + 1, total_of((count > 0).astype(float)).astype(I64), total_of(base), total_of(log_p) / LOG10])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, I64)] * 3 + [np.zeros(0)] * 2
        return pa.table(dict(zip(("uid", "n_tokens", "n_known", "base_score", "score"), (pa.array(x) for x in columns), strict=True)))

    done = chunked.groupBy("chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(score, "uid long, n_tokens long, n_known long, base_score double, score double")
    names = rows.select(F.col("uid").alias("__u"), "id")
    tokens = F.lit(vocab.tokens).cast("long").alias("train_tokens")
    return names.join(done, F.col("__u") == F.col("uid")).select("uid", "id", "n_tokens", "n_known", tokens, "base_score", "score")


def held_out(id_col: str = "id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scored(table(spark, sf_dir, "documents"), ~held_out())
    return done.select(F.col("id").alias("doc_id"), held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
