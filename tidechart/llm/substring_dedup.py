"""Substring deduplication by compaction of a De Bruijn graph of words.

The graph is kept sparse: of all token k-mers, the edges are those of least hash in some window (minimizers,
about two in W - k + 2 words). A window of W words that recurs holds the same edge at the same place each
time, so nothing is lost. An edge is stored with its path: the hash of all words of the windows that chose it.

* An edge that occurs once ends here.
* An edge that recurs with one path everywhere is nonbranching: its whole path is repeated. Such paths need
  no further look, and neighbours in a document run together into long repeated spans.
* An edge that recurs with several paths branches. One occurrence of each distinct path is opened into its
  W-word windows, and windows that two paths share are the repeated part; all occurrences take over what
  their path shares.

Source coordinates (row, first word, number of windows) go along, so spans are marked in the texts that
they come from. Windows are compared by two independent 64-bit hashes.

Defined cases: a null or empty text has no words; a text of under W words keeps them all; repeated rows are
copies of one another; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import numbered, stored, table
from tidechart.llm.tokens import Piece, pieces, sliding_min

WINDOW, EDGE = 35, 8
I64 = np.int64


def _edges(p: Piece, window: int, k: int):
    """(word of the edge, first window, last window) of every run of windows that choose one edge."""
    if len(p.hash) < window:
        return None
    edge = p.windows(k)
    span = window - k + 1
    low = sliding_min(edge, span)[: len(p.hash) - window + 1]
    # the leftmost least edge of each window: in place order, hash ties go to the left
    at = np.arange(len(low))
    inside = p.doc[: len(low)] == p.doc[window - 1 : window - 1 + len(low)]
    pick = np.full(len(low), -1, np.int64)
    todo = np.flatnonzero(inside)
    for step in range(span):
        hit = edge[todo + step] == low[todo]
        pick[todo[hit]] = at[todo[hit]] + step
        todo = todo[~hit]
        if not len(todo):
            break
    keep = np.flatnonzero(inside)
    if not len(keep):
        return None
    new = np.ones(len(keep), bool)
    new[1:] = (pick[keep[1:]] != pick[keep[:-1]]) | (np.diff(keep) != 1)
    first = keep[new]
    last = keep[np.append(np.flatnonzero(new)[1:] - 1, len(keep) - 1)]
    return edge[pick[first]], first, last


def _path_hash(p: Piece, first: np.ndarray, last: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words first..last+window-1 and of the edge's place among them."""
    from tidechart.llm.tokens import _BASE2, U, _powers, mix

    h = mix(p.hash2 ^ U(0x5851F42D4C957F2D))
    up, down = _powers(_BASE2, len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((total[last + window] - total[first]) * down[first] + (last - first).astype(np.uint64))


def edges(docs: DataFrame, window: int = WINDOW, k: int = EDGE) -> DataFrame:
    """(edge, path, uid, first, n): every edge occurrence; its windows are first..first+n-1 of row `uid`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for p in pieces(batch.column(1)):
                found = _edges(p, window, k)
                if found is None:
                    continue
                edge, first, last = found
                begin = np.searchsorted(p.doc, np.arange(p.last - p.first))
                doc = p.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edge.view(I64)),
                        pa.array(_path_hash(p, first, last, first, window).view(I64)),
                        pa.array(uid[p.first + doc]),
                        pa.array((first - begin[doc]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                    ],
                    names=["edge", "path", "uid", "first", "n"],
                )

    return docs.select("uid", "text").mapInArrow(run, "edge long, path long, uid long, first int, n int")


def open_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, edge, path, i) of the windows of the paths in `spots` of each row (uid, text, spots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(1)
            for p in pieces(batch.column(0)):
                own = spots.slice(p.first, p.last - p.first)
                row = own.value_parent_indices().to_numpy() if hasattr(own, "value_parent_indices") else np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                flat = own.flatten()
                edge, path, first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                begin = np.searchsorted(p.doc, np.arange(p.last - p.first))
                one, two = p.windows(window), p.windows(window, True)
                base = np.repeat(begin[row] + first, n)
                i = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
                at = base + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at].view(I64)), pa.array(two[at].view(I64)), pa.array(np.repeat(edge, n)), pa.array(np.repeat(path, n)), pa.array(i.astype(np.int32))],
                    names=["w1", "w2", "edge", "path", "i"],
                )

    return texts.select("text", "spots").mapInArrow(run, "w1 long, w2 long, edge long, path long, i int")


def _texts(docs: DataFrame) -> DataFrame:
    """(__u, text), stated alike wherever texts meet rows by uid, so that one shuffle serves all."""
    return docs.where(F.col("uid").isNotNull()).select(F.col("uid").alias("__u"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = EDGE) -> DataFrame:
    """(uid, first, n): runs of n repeated windows from word `first` on; docs: uid, text. Runs may touch."""
    found = stored(edges(docs, window, k), "edges")
    kinds = found.groupBy("edge").agg(F.count("*").alias("times"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    # stored, so that the join below is one of plain shuffles, whose hot edges Spark can split
    again = stored(kinds.where(F.col("times") > 1).select("edge", (F.col("lo") != F.col("hi")).alias("branches")), "again")
    repeated = stored(found.join(again, "edge"), "repeated")
    straight = repeated.where(~F.col("branches")).select("uid", "first", "n")
    # of each branching edge, one occurrence of each path; a path that recurs is repeated whole
    spot = F.struct("uid", "first", "n")
    paths = stored(repeated.where("branches").groupBy("edge", "path").agg(F.count("*").alias("times"), F.min(spot).alias("s")), "paths")
    to_open = paths.groupBy("s.uid").agg(F.collect_list(F.struct("edge", "path", "s.first", "s.n")).alias("spots"))
    texts = _texts(docs).join(to_open, F.col("__u") == F.col("uid")).select("text", "spots")
    windows = open_windows(texts, window)
    shared = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    partly = windows.join(shared, ["w1", "w2"]).groupBy("edge", "path").agg(F.collect_set("i").alias("marks"))
    whole = paths.where("times > 1").select("edge", "path", F.lit(True).alias("whole"))
    marks = whole.join(partly, ["edge", "path"], "full_outer")
    branching = repeated.where("branches").join(marks, ["edge", "path"])
    all_of_it = branching.where("whole").select("uid", "first", "n")
    marked = branching.where("whole is null").select("uid", "first", F.explode("marks").alias("i"))
    some = marked.select("uid", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("n"))
    return straight.unionByName(all_of_it).unionByName(some)


def cut(docs: DataFrame, spans: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(uid, n_words, n_removed, kept, kept_sha256): every row of `docs` without the words of its repeated windows.

    Without `texts`, kept is null and only its digest leaves the task.
    """
    by_row = spans.groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    rows = _texts(docs).join(by_row, F.col("__u") == F.col("uid"), "left").select(F.col("__u").alias("uid"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spots = batch.column(1), batch.column(2)
            n_words, n_removed, kept, sha = [], [], [], []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                words = text.encode().split() if text else []
                drop = 0
                if spots[i].is_valid:
                    own = spots[i].values
                    first, n = (own.field(j).to_numpy() for j in range(2))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.minimum(first + n + window - 1, len(words)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    drop = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                line = b" ".join(words)
                n_words.append(len(words) + drop)
                n_removed.append(drop)
                kept.append(line.decode() if texts else None)
                sha.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=["uid", "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.mapInArrow(run, "uid long, n_words long, n_removed long, kept string, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = EDGE, texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of every row of `docs`."""
    rows = numbered(docs, id_col, text_col)
    own = rows.select("uid", "text")
    done = cut(own, repeated_spans(own, window, k), window, texts)
    names = rows.select(F.col("uid").alias("__row"), "id")
    return names.join(done, F.col("__row") == F.col("uid")).drop("__row", "uid")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(table(spark, sf_dir, "documents"), texts=False)
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
