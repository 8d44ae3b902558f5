"""Importance resampling towards a target distribution of hashed word runs, with an exact distributed selection.

Features are runs of 1 to `max_n` words, hashed by CRC-32 into buckets. A bucket's gain says how much likelier it is in
the target than in the corpus; a document's weight is the floored mean of its features' gains, looked up in one array.
Its score is the weight plus Gumbel noise from a hash of its id, so the highest scores are a weighted sample without
replacement and reruns agree.

The highest scores are cut off by a weighted median of medians. Every task tells the median of its remaining keys; their
median, weighted by how many keys remain in each task, has a quarter of all remaining keys on either side for sure. One
pass counts both sides and finds their medians, the side that cannot hold the cutoff goes, and so on until the pivot is
the cutoff itself. The driver sees one row a task. Only the winners are sorted, in ranges.

Bounds: a task counts features in an array of `buckets` numbers, and the driver gets at most that many sums and sends
as many gains. A task holds the keys (24 bytes) of the split that it reads.

Defined cases: a null text has no words; a text without features weighs 0; a null id is hashed as no digits and comes
last among ties; rows that repeat are kept apart by row numbers; texts are read whole, in pieces of whole documents, very
long ones on their own; an empty table gives no rows, an empty target the gains of no counts; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import numbered, ranked_sums, stored, table
from tidechart.llm.tokens import PIECE_BYTES, text_buffers
from tidechart.operators.materialize import Rounds

#: Words of the contract, once A-Z are in lower case: anything but ASCII that is no letter or digit.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
MAX_N, BUCKETS, MIN_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Winners in a range that is sorted in one task, on average.
RANGE_ROWS = 50_000
#: Words over so many bytes are hashed one by one.
LONG = 64
LAST = (1 << 63) - 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [chr(b).isalnum() for b in range(128)]
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers (not inverted) after the bytes data[start:end] of each."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out, at, sizes = crc[order], start[order], size[order]
    long = int(np.searchsorted(-sizes, -LONG))
    for i in range(long):
        told = zlib.crc32(data[at[i] : at[i] + sizes[i]], int(out[i]) ^ 0xFFFFFFFF)
        out[i] = told ^ 0xFFFFFFFF
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # those with more than k bytes
        live = slice(long, n)
        out[live] = _STEP[(out[live] ^ data[at[live] + k]) & 255] ^ (out[live] >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def hashed_runs(column: pa.Array, max_n: int = MAX_N, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first, last, words of each document, [(document, bucket) of runs of 1, 2, ... words]) of pieces of a column."""
    data, offsets = text_buffers(column)
    space, first, n = np.array([32], np.uint8), 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1))
        own, at = _FOLD[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        inside = np.concatenate([[False], _IS_WORD[own], [False]])
        cut = np.zeros(len(own) + 1, bool)
        cut[at] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        doc = np.searchsorted(at, start, side="right") - 1
        held, runs = np.arange(len(start)), []
        crc = crc_on(np.full(len(start), 0xFFFFFFFF, np.uint32), own, start, end)
        for k in range(max_n):
            if k:  # runs grow by a space and the next word of the same document
                grow = np.flatnonzero((held + k < len(doc)) & (doc[np.minimum(held + k, len(doc) - 1)] == doc[held])) if len(doc) else held
                held, n_grow = held[grow], len(grow)
                crc = crc_on(crc[grow], space, np.zeros(n_grow, np.int64), np.ones(n_grow, np.int64))
                crc = crc_on(crc, own, start[held + k], end[held + k])
            runs.append((doc[held], ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)))
        yield first, last, np.bincount(doc, minlength=last - first), runs
        first = last


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, runs in hashed_runs(batch.column(0), max_n, buckets):
                for _, own in runs:
                    total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    summed = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b = len(corpus)
    whole = [float(int(x.sum())) + b for x in (corpus, target)]
    return np.array([math.floor(1000 * math.log((float(t) + 1) * whole[0] / ((float(s) + 1) * whole[1]))) for s, t in zip(corpus, target)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(uid, id, n_words, n_features, weight) of rows (uid, id, text)."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, n, runs in hashed_runs(batch.column(2), max_n, len(gain)):
                words[first:last] = n
                for doc, own in runs:
                    features[first:last] += np.bincount(doc, minlength=last - first)
                    sums[first:last] += np.bincount(doc, gain[own], last - first).astype(np.int64)
            weight = sums // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in (words, features, weight))], names=["uid", "id", "n_words", "n_features", "weight"])

    return rows.select("uid", "id", "text").mapInArrow(run, f"uid long, id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 times Gumbel noise) from the first 8 hex digits of the SHA-256 of `seed:id`."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit)))


# ---------------------------------------------------------------- selection
Key = tuple[int, int, int]


def _middle(keys: np.ndarray) -> list[int | None]:
    """The lower median of keys (a column each), or nulls where there are none."""
    if not keys.shape[1]:
        return [None, None, None]
    order = np.lexsort(keys[::-1])
    return [int(x) for x in keys[:, order[(len(order) - 1) // 2]]]


def _at_most(keys: np.ndarray, key: Key) -> np.ndarray:
    a, b, c = keys
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))


def _sides(keys: DataFrame, above: Key | None, upto: Key | None, pivot: Key | None) -> list[list[tuple[int, Key]]]:
    """For keys in (above, upto], by task: how many and which median, at most the pivot (or all), and beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            own = own[:, ~_at_most(own, above)] if above else own
            held.append(own[:, _at_most(own, upto)] if upto else own)
        own = np.concatenate(held, axis=1)
        left = _at_most(own, pivot) if pivot else np.ones(own.shape[1], bool)
        rows = [[int(mask.sum()), *_middle(own[:, mask])] for mask in (left, ~left)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for row in rows for x in row], names=[f"{side}{c}" for side in "lr" for c in "nabc"])

    near = keys
    if above:
        near = near.where(F.col("k1") >= above[0])
    if upto:
        near = near.where(F.col("k1") <= upto[0])
    told = near.mapInArrow(run, ", ".join(f"{side}{c} long" for side in "lr" for c in "nabc")).collect()
    return [[(row[i], tuple(row[i + 1 : i + 4])) for row in told if row[i]] for i in (0, 4)]


def weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """The least median up to which the tasks hold half of the keys."""
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def kth_key(keys: DataFrame, k: int) -> Key:
    """The k-th least of the distinct keys (k1, k2, k3), from 1 on; `keys` is stored and has at least k rows."""
    steps = Rounds(keys.sparkSession, "remaining", keep=1)
    above = upto = None
    medians, _ = _sides(keys, None, None, None)
    stored_rows = sum(n for n, _ in medians)
    while True:
        pivot = weighted_median(medians)
        left, right = _sides(keys, above, upto, pivot)
        n_left = sum(n for n, _ in left)
        if k == n_left:
            return pivot
        if k < n_left:
            upto, medians = pivot, left
        else:
            above, medians, k = pivot, right, k - n_left
        remaining = sum(n for n, _ in medians)
        if remaining * 8 < stored_rows:  # read no more than what is left
            keys, stored_rows = steps.put(keys.where(_within(above, upto))), remaining


def _within(above: Key | None, upto: Key | None) -> Column:
    own = F.struct("k1", "k2", "k3")
    as_key = lambda key: F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(key, ("k1", "k2", "k3"))])
    out = F.lit(True)
    if above:
        out = out & (own > as_key(above))
    if upto:
        out = out & (own <= as_key(upto))
    return out


def first_k(keys: DataFrame, k: int) -> DataFrame:
    """(uid, rank) of the k least keys (k1, k2, k3 = uid). Ranks come from ranges, each sorted in a task of its own."""
    won = keys.where(_within(None, kth_key(keys, k))) if k else keys.limit(0)
    parts = max(1, -(-k // RANGE_ROWS))
    dealt = stored(won.repartitionByRange(parts, "k1", "k2", "k3").select("*", F.spark_partition_id().alias("part"), F.lit(1).alias("one")), "winners")
    placed = ranked_sums(dealt, [], "part", [F.col("k1"), F.col("k2"), F.col("k3")], {"before": "one"})
    return placed.select(F.col("k3").alias("uid"), (F.col("before") + 1).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(uid, id, n_words, n_features, weight, score, rank) of every row of `docs`, whose ids are integers.

    rank: the place among the floor(share N / 100) highest scores of the N documents with `min_words` words or more,
    null for all others; of equal scores the smaller id comes first.
    """
    rows = numbered(docs, id_col, text_col)
    gain = gains(bucket_counts(rows, "text", max_n, buckets), bucket_counts(target, text_col, max_n, buckets))
    scored = weighed(rows, gain, max_n)
    scored = stored(scored.withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long")), "scores")
    keys = scored.where(F.col("n_words") >= min_words).select((-F.col("score")).alias("k1"), F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("k2"), F.col("uid").alias("k3"))
    drawn = first_k(keys, share * keys.count() // 100)
    return scored.join(drawn, "uid", "left")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
