"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon, its nearness to second-person words, capitals, punctuation and obfuscation
rates, and a few more counts. The lexicon (words and word stems) is learned from labelled texts by log odds
with a prior, as are trees and calibration. Training takes at most `max_labels` labelled rows, those of least
id hash; scoring takes every text whole.

Defined cases: a null or empty text gets the score of no features; labels that are null are left out, and a
document with several labels counts as toxic if one of them says so; with labels of one class or none the
score is that class's share or 0.5; of entries with equal z-scores the lexicon takes words before stems; very long
texts are read whole, a piece each; repeated rows are scored one by one; without documents there are no rows, and
the model is that of no labels; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.boosting import Trees, calibrated, fit_isotonic, fit_trees
from tidechart.llm.common import stored, table
from tidechart.llm.tokens import _BASE, U, _powers, mix, text_buffers

#: Labelled rows that training takes at most.
MAX_LABELS = 20_000
#: Entries of the lexicon at most, and the least z-score and number of toxic texts of an entry.
LEXICON, LEAST_Z, LEAST_TEXTS = 512, 3.5, 5
STEMS = (4, 5, 6)
NEAR, FOLDS = 4, 5
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch euer sie ihr tu te toi ton ta tes vous votre vos usted ustedes ti tus su sus vosotros"
PIECE = 1 << 20

_TABLE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LEET = _FOLD.copy()
_LEET[[48, 49, 51, 52, 53, 55, 64, 36, 33]] = np.frombuffer(b"oieastasi", np.uint8)
_LEET_WORD = _ALNUM.copy()
_LEET_WORD[[64, 36, 33]] = True


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    total: np.ndarray
    down: np.ndarray

    def keys(self, stem: int = 0) -> np.ndarray:
        """Hashes of whole words, or of their first `stem` bytes where they are longer than that (else 0)."""
        end = np.minimum(self.end, self.start + stem) if stem else self.end
        h = mix((self.total[end] - self.total[self.start]) * self.down[self.start] + U(stem * 257))
        return np.where(self.end - self.start > stem, h, U(0)) if stem else h


def _words(own: np.ndarray, at: np.ndarray, fold: np.ndarray, is_word: np.ndarray) -> Words:
    word = is_word[own]
    cut = np.zeros(len(own) + 1, bool)
    cut[at] = True
    before, after = np.zeros(len(own), bool), np.zeros(len(own), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _powers(_BASE, len(own) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[fold[own]] * up[:-1])])
    return Words(start, end, np.searchsorted(at, start, side="right") - 1, total, down)


def _split(column: pa.Array):
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _hashed(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    return np.unique(_words(data, np.array([0, len(data)]), _FOLD, _ALNUM).keys())


@dataclass
class Lexicon:
    """Sorted hashes and their log odds: [0] of words, then of stems by length."""

    keys: list[np.ndarray]
    odds: list[np.ndarray]

    def weight(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.start))
        for stem, keys, odds in zip((0, *STEMS), self.keys, self.odds, strict=True):
            if len(keys) and len(out):
                h = w.keys(stem)
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out = np.maximum(out, np.where(keys[i] == h, odds[i], 0.0))
        return out


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of dense features for each text."""
    person = _hashed(SECOND_PERSON)
    out = []
    for first, last, own, at in _split(column):
        n = last - first
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) if len(own) else np.zeros(n)  # noqa: E731, B023
        w = _words(own, at, _FOLD, _ALNUM)
        per = lambda v, doc=w.doc: np.bincount(doc, v, n)[:n] if len(doc) else np.zeros(n)  # noqa: E731, B023
        weight = lexicon.weight(w)
        hit = weight > 0
        you = np.isin(w.keys(), person)
        near = np.zeros(len(hit), bool)
        for d in range(1, NEAR + 1):
            same = w.doc[d:] == w.doc[:-d]
            near[d:] |= you[:-d] & same
            near[:-d] |= you[d:] & same
        leet = _words(own, at, _LEET, _LEET_WORD)
        masked = per((lexicon.weight(leet) > 0).astype(float), leet.doc)
        letter, alnum = _LETTER[own], _ALNUM[own]
        upper = (own >= 65) & (own <= 90)
        inner = np.zeros(len(own), bool)
        if len(own) > 2:
            inner[1:-1] = (~alnum[1:-1] & (own[1:-1] > 32) & (own[1:-1] != 39) & (own[1:-1] != 45) & letter[:-2] & letter[2:]) | ((own[1:-1] >= 48) & (own[1:-1] <= 57) & letter[:-2])
        size = np.maximum(np.diff(at), 1)
        words = np.bincount(w.doc, minlength=n)[:n] if len(w.doc) else np.zeros(n)
        some = np.maximum(words, 1)
        hits = per(hit.astype(float))
        top = np.zeros(n)
        np.maximum.at(top, w.doc, weight)
        out.append(
            np.stack(
                [
                    np.log1p(words), hits, hits / some * 100, per(weight), per(weight) / some * 100, top,
                    per((hit & near).astype(float)) / some * 100, per(you.astype(float)) / some * 100, np.maximum(masked - hits, 0) / some * 100,
                    count(upper) / size, count((own == 33) | (own == 63)) / size, count(~alnum & (own > 32)) / size, count(inner) / size,
                    count((own >= 48) & (own <= 57)) / size, count(own >= 128) / size, count(own == 10) / some, size / some,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, 17))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(stem, key, fold, toxic, clean): labelled texts (text, toxic, fold) of each fold that hold each word or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            for first, last, own, at in _split(batch.column(0)):
                w = _words(own, at, _FOLD, _ALNUM)
                for stem in (0, *STEMS):
                    pair = np.unique(np.stack([w.keys(stem), w.doc.astype(np.uint64)]), axis=1)
                    pair = pair[:, pair[0] != 0]
                    doc = pair[1].astype(np.int64)
                    keys, back = np.unique(pair[0], return_inverse=True)
                    label, part = y[first:last][doc], fold[first:last][doc]
                    for k in np.unique(part):
                        in_fold = part == k
                        held, at_key = np.unique(back[in_fold], return_inverse=True)
                        count = lambda v, at_key=at_key, n=len(held), own=label[in_fold]: pa.array(np.bincount(at_key, own == v, n).astype(np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(held), stem, np.int32)), pa.array(keys[held].view(np.int64)), pa.array(np.full(len(held), k, np.int32)), count(1), count(0)],
                            names=["stem", "key", "fold", "toxic", "clean"],
                        )

    counted = labelled.select("text", "toxic", "fold").mapInArrow(run, "stem int, key long, fold int, toxic long, clean long")
    return counted.groupBy("stem", "key", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_of(counts: DataFrame, sizes: dict[int, tuple[float, float]], without: int | None = None) -> Lexicon:
    """The lexicon of all folds but one. counts: as of word_counts; sizes: toxic and clean texts by fold."""
    nt, nc = (sum(v[i] for k, v in sizes.items() if k != without) for i in (0, 1))
    kept = counts if without is None else counts.where(F.col("fold") != without)
    summed = kept.groupBy("stem", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a * (nc + 1) / (b * (nt + 1)))
    found = summed.where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    top = found.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "stem", "key").limit(LEXICON).select("stem", "key", "odds").toPandas()
    keys, values = [], []
    for stem in (0, *STEMS):
        own = top[top["stem"] == stem]
        k, v = own["key"].to_numpy(np.int64).view(np.uint64), own["odds"].to_numpy(float)
        order = np.argsort(k)
        keys.append(k[order])
        values.append(v[order])
    return Lexicon(keys, values)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, column: pa.Array) -> np.ndarray:
        return calibrated(self.trees.margin(features(column, self.lexicon)), self.knots)


def training_rows(docs: DataFrame, labels: DataFrame, may_train: Column, max_labels: int = MAX_LABELS) -> DataFrame:
    """(text, toxic) of at most `max_labels` labelled documents, those of least id hash among `may_train`."""
    known = labels.where(F.col("toxic").isNotNull() & may_train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_labels)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"])


def fit(rows: DataFrame) -> Model:
    """A model of labelled rows (text, toxic), whose number the caller has bounded.

    Calibration learns from margins of rows that neither the trees nor the lexicon behind them have seen: in five
    turns, both are learned from the other four folds.
    """
    folded = rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(23)), F.lit(FOLDS)).cast("int"))
    told = folded.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    sizes = {r["fold"]: (float(r["t"]), float(r["n"] - r["t"])) for r in told}
    counts = stored(word_counts(folded), "words")
    lexica = [lexicon_of(counts, sizes, k) for k in (None, *range(FOLDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([features(batch.column(0), own) for own in lexica], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int64()), batch.column(2), batch.column(3)], names=["x", "y", "fold", "k"])

    data = folded.select("text", "toxic", "fold", F.xxhash64("text").alias("k")).mapInArrow(run, "x array<double>, y long, fold int, k long").toPandas().sort_values("k")
    if not len(data):
        return Model(lexica[0], fit_trees(np.zeros((0, 17)), np.zeros(0)), (np.array([0.0]), np.array([0.5])))
    x, y, fold = np.stack(data["x"].to_list()), data["y"].to_numpy(float), data["fold"].to_numpy()
    width, margin = x.shape[1] // len(lexica), np.zeros(len(x))
    for k in range(FOLDS):
        own = x[:, width * (k + 1) : width * (k + 2)]
        if (fold != k).any() and (fold == k).any():
            margin[fold == k] = fit_trees(own[fold != k], y[fold != k]).margin(own[fold == k])
    return Model(lexica[0], fit_trees(x[:, :width], y), fit_isotonic(margin, y))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def accepted(docs: DataFrame, model: Model, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is below a limit."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) < below))

    return docs.mapInArrow(run, docs.schema)


def fold_of(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: learned from labelled rows outside fold 0."""
    return fit(training_rows(docs, labels, fold_of() != 0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return done.select(F.col("id").alias("doc_id"), F.coalesce(fold_of("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
