"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Vectors are dealt to shards by their length, in bands, and within a band by id hash; the number of shards of a band
grows with the fourth root of the rows, their size with the rest, so the walks in all stay far from the square of the
rows. Each shard builds a hierarchical graph over its distinct vectors (equal ones are one node with its ids in order): levels drawn from the vector, M links a node and level (2M
on the ground), chosen so that a link is not nearer to another link than to the node; neighbours lie in flat integer
arrays, -1 where open. Nodes join in batches that each search the graph built so far and one another; queries of a
block walk in step, so a hop is a few numpy calls for the whole block. A query's beam is doubled until its k best stay the
same. Every shard answers every query with its k best; the answers of all shards are merged. A graph is
loaded once by each task that asks it, and queries pass through.

The measure is the inner product. Vectors get one more component, sqrt(R^2 - |x|^2), with R the greatest length of their
shard: that turns largest inner product into nearest by angle on one sphere, and a few long vectors do not crowd the
others of all lengths into a point. The beam keeps its best by that, and scores are computed on the original vectors in
double precision.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part; equal vectors are neighbours like others; repeated ids are kept as rows and may both be
returned, but never answer for their own id; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives no rows; other columns are ignored, whatever their names; there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.llm.common import stored, table

K, EVERY = 20, 20
#: Vectors of a band of lengths, a factor of BAND wide, have as many shards as the fourth root of their number over SHARD
#: says, and more where one would have over MOST bytes.
BAND, SHARD, MOST = 16, 1_500, 256 << 20
LINKS, BUILD = 16, 96
#: Queries that a task takes at once. Of them, as many walk in step as marks of seen nodes fit in SEEN bytes.
BLOCK, SEEN = 4096, 32 << 20


@dataclass
class Graph:
    """x: unit vectors; layers: for each level the neighbours of all nodes, -1 where open; level of each
    node; order: each node's place among the given vectors."""

    x: np.ndarray
    layers: list[np.ndarray]
    level: np.ndarray
    entry: int
    order: np.ndarray


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the `width` best found for each query by best-first walks in step, best first; -1 pads."""
    m, n = len(q), len(x)
    rows = np.arange(m)
    marks = np.zeros(m * n, bool)  # what a walk has seen
    ids = np.full((m, width), -1, np.int64)
    sim = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    s = starts.shape[1]
    ids[:, :s], done[:, :s] = starts, starts < 0
    sim[:, :s] = np.where(starts >= 0, np.einsum("md,msd->ms", q, x[starts]), -np.inf)
    r, c = np.nonzero(starts >= 0)
    marks[r * n + starts[r, c]] = True
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim, done = (np.take_along_axis(a, order, 1) for a in (ids, sim, done))
    live = rows
    # several open nodes of a walk are left in one step: fewer, larger calls
    most = max(4, width // 12)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        # the best open nodes of each walk
        take = open_ & (np.cumsum(open_, axis=1) <= most)
        done[live] |= take
        r, c = np.nonzero(take)
        near = links.take(ids[live[r], c], axis=0)
        pair = (live[r, None] * n + near)[near >= 0]
        pair = pair[~marks.take(pair)]
        if not len(pair):
            continue
        # one of each pair, in order of the walks
        pair.sort()
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
        marks[pair] = True
        walk, node = np.divmod(pair, n)
        score = np.einsum("ij,ij->i", q.take(walk, axis=0), x.take(node, axis=0))
        better = score > sim[walk, -1]
        walk, node, score = walk[better], node[better], score[better]
        count = np.bincount(walk, minlength=m)
        grown = np.flatnonzero(count)
        if not len(grown):
            continue
        wide = int(count.max())
        col = np.arange(len(walk)) - np.repeat(np.cumsum(count[grown]) - count[grown], count[grown])
        at = np.searchsorted(grown, walk)
        new_ids = np.full((len(grown), wide), -1, np.int64)
        new_sim = np.full((len(grown), wide), -np.inf, np.float32)
        new_ids[at, col], new_sim[at, col] = node, score
        ids_all = np.concatenate([ids[grown], new_ids], axis=1)
        sim_all = np.concatenate([sim[grown], new_sim], axis=1)
        done_all = np.concatenate([done[grown], new_ids < 0], axis=1)
        best = np.argsort(-sim_all, axis=1, kind="stable")[:, :width]
        ids[grown], sim[grown], done[grown] = (np.take_along_axis(a, best, 1) for a in (ids_all, sim_all, done_all))
    return ids, sim


def _chosen(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first), those nearer to the node than to any chosen before; then the best others."""
    m, w = cand.shape
    vec = x[np.maximum(cand, 0)]
    between = np.einsum("mwd,mvd->mwv", vec, vec)
    taken = np.zeros((m, w), bool)
    for j in range(w):
        blocked = (taken[:, :j] & (between[:, j, :j] > sim[:, j : j + 1])).any(1)
        taken[:, j] = (cand[:, j] >= 0) & (cand[:, j] != own) & ~blocked & (taken.sum(1) < most)
    rank = np.where(taken, 0, 1) + np.where((cand < 0) | (cand == own[:, None]), 4, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.full((m, most), -1, np.int64)
    picked = np.take_along_axis(cand, order, 1)
    out[:, : picked.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 4, picked, -1)
    return out


def _linked(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Set the links of `nodes` and add the reverse links, choosing again where a node has too many."""
    most = links.shape[1]
    links[nodes, : chosen.shape[1]] = chosen
    to, back = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
    keep = to >= 0
    to, back = to[keep], back[keep]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    held = (links[targets] >= 0).sum(1)
    # where all fit, they stand behind what is there
    easy = held + count <= most
    row = np.repeat(np.flatnonzero(easy), count[easy])
    col = np.arange(len(row)) - np.repeat(np.cumsum(count[easy]) - count[easy], count[easy])
    links[targets[row], held[row] + col] = back[first[row] + col]
    targets, first, count = targets[~easy], first[~easy], count[~easy]
    for lo in range(0, len(targets), 512):
        t, f, c = targets[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
        wide = np.full((len(t), most + int(c.max())), -1, np.int64)
        wide[:, :most] = links[t]
        row = np.repeat(np.arange(len(t)), c)
        col = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        wide[row, most + col] = back[np.repeat(f, c) + col]
        sim = np.where(wide >= 0, np.einsum("md,mwd->mw", x[t], x[np.maximum(wide, 0)]), -np.inf)
        order2 = np.lexsort((wide, -sim), axis=1)
        wide, sim = np.take_along_axis(wide, order2, 1), np.take_along_axis(sim, order2, 1)
        twice = np.zeros(wide.shape, bool)
        twice[:, 1:] = wide[:, 1:] == wide[:, :-1]
        order2 = np.argsort(twice | (wide < 0), axis=1, kind="stable")[:, : most + 16]
        wide = np.take_along_axis(np.where(twice, -1, wide), order2, 1)
        sim = np.take_along_axis(np.where(twice, -np.inf, sim), order2, 1)
        # a quarter of the places stay open, so that a node is chosen for again only after some more links
        links[t] = -1
        links[t, : most * 3 // 4] = _chosen(x, t, wide, sim, most * 3 // 4)


def build(x: np.ndarray, ids: np.ndarray, links: int = LINKS, width: int = BUILD) -> Graph:
    """A graph over distinct unit vectors; ids: any number of each, which draws its level."""
    n = len(x)
    draw = (np.asarray(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
    level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 4)
    order = np.argsort(-level, kind="stable")  # upper levels first: their nodes are everybody's way in
    x, level = x[order], level[order]
    top = int(level[0]) if n else 0
    layers = [np.full((int((level >= k).sum()), links * (2 if k == 0 else 1)), -1, np.int64) for k in range(top + 1)]
    entry = 0
    at = 1
    while at < n:
        step = min(n - at, max(1, min(at, 512, SEEN // n)))
        nodes = np.arange(at, at + step)
        start = np.full((step, 1), entry)
        for k in range(top, -1, -1):
            size = min(at, len(layers[k]))
            own = nodes[nodes < len(layers[k])]
            found, sim = _beam(x[: max(size, 1)], layers[k][: max(size, 1)], x[nodes], start, width if len(own) else 4)
            if len(own):
                # nodes of one batch see each other too
                mates = x[own] @ x[own].T
                np.fill_diagonal(mates, -np.inf)
                near = np.argsort(-mates, axis=1)[:, : min(links, len(own))]
                cand = np.concatenate([found[: len(own)], own[near]], axis=1)
                near_sim = np.take_along_axis(mates, near, 1)
                cand = np.where(np.concatenate([sim[: len(own)], near_sim], axis=1) > -np.inf, cand, -1)
                both = np.concatenate([sim[: len(own)], near_sim], axis=1)
                best = np.argsort(-both, axis=1, kind="stable")[:, : width // 2]
                _linked(x, layers[k], own, _chosen(x, own, np.take_along_axis(cand, best, 1), np.take_along_axis(both, best, 1), links))
            start = found[:, : min(4, found.shape[1])]
        at += step
    return Graph(x, layers, level, entry, order)


def search(graph: Graph, q: np.ndarray, k: int, settle: int) -> np.ndarray:
    """Places in the given vectors of the k best found for each query, best first; -1 pads.

    The beam of a query is doubled until its `settle` best stay the same.
    """
    n = len(graph.x)
    out = np.full((len(q), k), -1, np.int64)
    some = max(1, SEEN // max(n, 1))
    for lo in range(0, len(q), some):
        todo = np.arange(lo, min(lo + some, len(q)))
        start = np.full((len(todo), 1), graph.entry)
        for level in range(len(graph.layers) - 1, 0, -1):
            m = len(graph.layers[level])
            start = _beam(graph.x[:m], graph.layers[level], q[todo], start, 8)[0]
        beam, last = 4 * settle, None
        while len(todo):
            found = _beam(graph.x, graph.layers[0], q[todo], start, max(8, min(beam, n)))[0]
            best = np.full((len(todo), k), -1, np.int64)
            most = min(k, found.shape[1])
            best[:, :most] = found[:, :most]
            out[todo] = np.where(best >= 0, graph.order[np.maximum(best, 0)], -1)
            if beam >= n:
                break
            # wider as long as any of the best is new
            top = found[:, :settle]
            moved = np.ones(len(todo), bool) if last is None else (top[:, :, None] != last[:, None, :]).all(2).any(1)
            todo, start, last = todo[moved], found[moved, :8], top[moved]
            beam *= 2
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    length = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d").first()
    return kept.where(F.size("v") == (length["d"] if length else 0))


def _lifted(v: np.ndarray) -> np.ndarray:
    """Vectors over the greatest length among them, with what they lack to it as one more component."""
    own = v / np.abs(v).max()
    length2 = (own * own).sum(1)
    rest = np.sqrt(length2.max() - length2)
    return (np.concatenate([own, rest[:, None]], axis=1) / np.sqrt(length2.max())).astype(np.float32)


def _distinct(v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, their first ids, the vector of each id) in order of the least id of each; ids ascend."""
    v = v + 0.0  # -0.0 is 0.0
    _, first, of = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return v[first[order]], ids[first[order]], place[of.ravel()]


GRAPH = "shard int, ids array<long>, node array<int>, v array<double>, place array<int>, level array<int>, links array<array<int>>"


def dealt(vectors: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """(shard, id, v) and the number of shards. Lengths of a shard differ by a factor of BAND at most.

    shards: how many the vectors would get, were they all of one length.
    """
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    length = F.log(top) + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))) / 2
    banded = vectors.withColumn("band", F.round(length / np.log(BAND)).cast("int"))
    # doubles span 2^2098, so there are some 525 bands at most
    counts = banded.groupBy("band").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).orderBy("band").collect()
    total = sum(r["n"] for r in counts)
    first, at = {}, 0
    for r in counts:
        fit = shards * r["n"] / total if shards else max((r["n"] / SHARD) ** 0.25, r["n"] * r["d"] * 8 / MOST)
        first[r["band"]] = (at, max(1, round(fit)))
        at += first[r["band"]][1]
    if not counts:
        return vectors.select(F.lit(0).alias("shard"), "id", "v"), 0
    begin, many = (F.create_map(*[F.lit(x) for band, told in first.items() for x in (band, told[i])])[F.col("band")] for i in (0, 1))
    return banded.select((begin + F.pmod(F.xxhash64("id"), many)).cast("int").alias("shard"), "id", "v"), at


def graphs(sharded: DataFrame) -> DataFrame:
    """A row for each shard: its ids, the node of each, the nodes' vectors, and the graph as flat arrays. sharded: shard, id, v."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        v, first, node = _distinct(np.stack(group["v"].to_list()), group["id"].to_numpy())
        g = build(_lifted(v), first)
        row = {
            "shard": group["shard"].iat[0], "ids": group["id"].to_numpy(), "node": node.astype(np.int32), "v": v.ravel(), "place": g.order.astype(np.int32),
            "level": g.level.astype(np.int32), "links": [x.ravel().astype(np.int32) for x in g.layers],
        }
        return pd.DataFrame([row])

    return sharded.groupBy("shard").applyInPandas(run, GRAPH)


@dataclass
class Shard:
    """One loaded row of `graphs`."""

    graph: Graph
    v: np.ndarray
    ids: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, row: pd.Series) -> Shard:
        ids, node, place, level = (np.asarray(row[c], np.int64) for c in ("ids", "node", "place", "level"))
        v = np.asarray(row["v"]).reshape(len(place), -1)
        layers = [np.asarray(x, np.int64).reshape(int((level >= i).sum()), -1) for i, x in enumerate(row["links"])]
        return cls(Graph(_lifted(v)[place], layers, level, 0, place), v, ids, node)


def answers(graph: Graph, v: np.ndarray, ids: np.ndarray, node: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): up to k best ids of each query, other than its own, from one graph.

    ids ascend; node: the place in v of each. A node answers with its k + 1 least ids, of which one may be the query's.
    """
    unit = q / np.abs(q).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    found = search(graph, np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32), k + 8, k)
    by_node = np.argsort(node, kind="stable")
    begin = np.searchsorted(node[by_node], np.arange(len(v) + 1))
    row, c = np.nonzero(found >= 0)
    place = found[row, c]
    score = np.einsum("nd,nd->n", q[row], v[place])
    many = np.minimum(np.diff(begin)[place], k + 1)
    row, score = np.repeat(row, many), np.repeat(score, many)
    at = np.repeat(begin[place], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    own = ids[by_node[at]]
    keep = own != qid[row]
    row, own, score = row[keep], own[keep], score[keep]
    order = np.lexsort((own, -score, row))
    row, own, score = row[order], own[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], own[rank < k], score[rank < k]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, shards: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query among vectors of other ids. Both: id, v.

    A task loads the graph of one shard and sends queries through it, some at a time. Each shard has as many such tasks
    as the session's parallelism takes, whatever the number of queries.
    """
    sharded, shards = dealt(stored(vectors, "vectors"), shards)
    parts = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // max(shards, 1)))
    built = stored(graphs(sharded), "graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = built.select("*", every(parts).alias("part"), F.lit(0).cast("long").alias("query_id"))
    asked = queries.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int").alias("part"), F.col("id").alias("query_id"), F.col("v").alias("q"), every(max(shards, 1)).alias("shard"))
    both = held.unionByName(asked, allowMissingColumns=True)
    # the graph comes before the queries
    placed = both.repartitionById(max(shards, 1) * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "part", F.col("ids").isNull())

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            starts = batch["ids"].notna().to_numpy()
            for _, run in batch.groupby(np.cumsum(starts)):
                if run["ids"].iat[0] is not None:
                    shard, run = Shard.of(run.iloc[0]), run.iloc[1:]
                for lo in range(0, len(run) if shard else 0, BLOCK):
                    some = run.iloc[lo : lo + BLOCK]
                    qid = some["query_id"].to_numpy(np.int64)
                    r, own, score = answers(shard.graph, shard.v, shard.ids, shard.node, np.stack(some["q"].to_list()), qid, k)
                    yield pd.DataFrame({"query_id": qid[r], "id": own, "score": score})

    found = placed.mapInPandas(answer, "query_id long, id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    found = neighbours(vectors, vectors.where(F.col("id") % EVERY == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
