"""Resharding by minimum-cost flow.

Rows lie in old shards, which are folders of files. Old shard sizes and new capacities make a transport problem
whose flow says how many bytes go from each old to each new shard so that the fewest move. Blocks of rows (equal
texts of an old shard together) are dealt out by that flow, pair by pair, and only files of shards that gain or
lose rows are written again.

The flow and the choice of blocks work on a table of blocks whose number is bounded by `blocks`, by the number of
old shards and by PARTS; rows never leave Spark. A block over its share (a hot group of copies) is divided by row.

Defined cases: a null text has no bytes, counts 1, and has the CRC of the empty text; an empty table gives no rows;
repeated rows are placed one by one; null ids are kept, and spread like others; of texts of equal size, none comes
first: blocks decide by their number; a text longer than a block's share is a block of its own, which the sizes
of shards cannot do without; other columns are ignored by `reshard` and kept by `rewrite`, whatever their names,
but for `shard`, which gives way to the new one.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.llm.common import stored, table
from tidechart.operators.materialize import shared_folder, written

SHARDS, OLD_SHARDS = 8, 6
#: Blocks of an old shard at most; more make finer shards and a larger table of blocks.
BLOCKS = 8192
#: Parts of a block over one SPLIT-th of a shard; at most SPLIT blocks a shard are that large.
PARTS, SPLIT = 256, 32
#: Columns of a layout: a row's shard, and its number.
LAYOUT, ROW = "__layout", "__row"
#: Rows of a shard that are numbered in one task, on average at most.
NUMBERED = 50_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Least-cost transport by successive shortest paths with potentials. Total supply must not exceed demand."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room, pot = list(supply), list(demand), [0] * (n + m)
    while any(left):
        dist, came = [np.inf] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = -pot[i]
                heap.append((dist[i], i))
        heapq.heapify(heap)
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            edges = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in edges:
                step = d + c + pot[u] - pot[v]
                if step < dist[v]:
                    dist[v], came[v] = step, u
                    heapq.heappush(heap, (step, v))
        ends = [j for j in range(m) if room[j] and dist[n + j] < np.inf]
        if not ends:
            raise ValueError("supply exceeds demand")
        last = min(ends, key=lambda j: dist[n + j] + pot[n + j])
        path, v = [], n + last
        while v >= 0:
            path.append(v)
            v = came[v]
        path.reverse()
        pot = [p + d if d < np.inf else p for p, d in zip(pot, dist, strict=True)]
        most = min(left[path[0]], room[last], *[flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n] or [left[path[0]]])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        room[last] -= most
    return flow


def assign_blocks(old: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The new shard of each block: of old shard i, flow[i][j] bytes go to j, up to the size of one block.

    An old shard's blocks are taken by size, each to the pair with the most flow left; what a pair is short of or
    over by is carried on to the next old shard's flow, so shards end within a block of their capacity.
    """
    n_old = max(int(old.max()) + 1 if len(old) else 0, shards)
    supply = [int(size[old == i].sum()) for i in range(n_old)]
    total = sum(supply)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(n_old)])
    new = np.full(len(old), -1)
    by_size = np.lexsort((np.arange(len(size)), -size))
    carried = [0] * shards
    for i in range(n_old):
        goes = [j for j in range(shards) if flow[i][j]]
        left = [(-(flow[i][j] + carried[j]), j) for j in goes]
        heapq.heapify(left)
        for k in by_size[old[by_size] == i]:
            room, j = left[0]
            new[k] = j
            heapq.heapreplace(left, (room + int(size[k]), j))
        for room, j in left:
            carried[j] = -room
    return new


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _size(text_col: str) -> Column:
    return (F.octet_length(_text(text_col)) + 1).cast("long")


def _keys(old_shard: Column, row: Column, text_col: str, blocks: int) -> dict[str, Column]:
    """A row's old shard, block (by text) and part of that block (by row)."""
    return {
        "__old": old_shard.cast("int"),
        "__block": F.pmod(F.xxhash64(_text(text_col)), F.lit(blocks)).cast("int"),
        "__part": F.pmod(F.xxhash64(row, F.lit(7)), F.lit(PARTS)).cast("int"),
    }


def _row(docs: DataFrame, id_col: str) -> Column:
    """What tells rows apart: the layout's row number, else the id, or where that is null the place in the files."""
    if ROW in docs.columns:
        return F.col(ROW)
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.monotonically_increasing_id())


def plan_blocks(rows: DataFrame, shards: int = SHARDS):
    """A pandas table of units (__old, __block, sub; bytes, shard): where each goes. rows: __old, __block, __part, size.

    A block over one SPLIT-th of a shard is divided into its parts (sub >= 0), the others stay whole (sub -1).
    """
    parts = rows.groupBy("__old", "__block", "__part").agg(F.sum("size").alias("bytes"))
    parts = stored(parts, "parts")
    most = (parts.agg(F.sum("bytes").alias("s")).first()["s"] or 0) / shards / SPLIT
    whole = parts.groupBy("__old", "__block").agg(F.sum("bytes").alias("bytes")).withColumn("sub", F.lit(-1))
    hot = whole.where(F.col("bytes") > most).select("__old", "__block")
    divided = parts.join(F.broadcast(hot), ["__old", "__block"]).select("__old", "__block", "bytes", F.col("__part").alias("sub"))
    units = whole.where(F.col("bytes") <= most).unionByName(divided).toPandas()
    units = units.sort_values(["__old", "__block", "sub"], ignore_index=True)
    units["shard"] = assign_blocks(units["__old"].to_numpy(np.int64), units["bytes"].to_numpy(np.int64), shards) if len(units) else []
    return units


def place(rows: DataFrame, units) -> DataFrame:
    """`rows` (with __old, __block, __part) with __shard, by a broadcast of `units`; no row moves."""
    listed = [[int(x) for x in r] for r in units[["__old", "__block", "sub", "shard"]].values]
    goes = rows.sparkSession.createDataFrame(listed, "__o int, __b int, __sub int, __shard int")
    whole = goes.where("__sub < 0").drop("__sub").withColumnRenamed("__shard", "__whole")
    here = (F.col("__old") == F.col("__o")) & (F.col("__block") == F.col("__b"))
    out = rows.join(F.broadcast(whole), here, "left").drop("__o", "__b")
    out = out.join(F.broadcast(goes.where("__sub >= 0")), here & (F.col("__part") == F.col("__sub")), "left")
    return out.withColumn("__shard", F.coalesce("__whole", "__shard")).drop("__o", "__b", "__sub", "__whole")


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, carry: bool = False) -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot) of every row; with `carry` also doc, a struct of its columns.

    `slot` counts rows of a shard from 0 without gaps: rows are numbered in buckets, whose counts are summed up.
    """
    keys = _keys(old_shard, _row(docs, id_col), text_col, blocks)
    kept = [F.struct(*[F.col(c) for c in docs.columns if c not in (LAYOUT, ROW)]).alias("doc")] if carry else []
    own = docs.select(
        *kept, F.col(id_col).alias("__id"), _size(text_col).alias("__size"), F.crc32(_text(text_col)).alias("__crc"), *[c.alias(k) for k, c in keys.items()],
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("__n"),
    )
    # unless they lie in a layout, rows are written once: all that follows agrees on their numbers
    rows = own if ROW in docs.columns else stored(own, "keys")
    placed = place(rows, plan_blocks(rows.withColumnRenamed("__size", "size"), shards))
    buckets = max(1, -(-rows.count() // NUMBERED))
    dealt = placed.withColumn("__bucket", F.pmod(F.xxhash64("__n", F.lit(5)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("__shard", "__bucket").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("__shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(F.col("__shard").alias("__s"), F.col("__bucket").alias("__k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    seat = F.row_number().over(W.partitionBy("__shard", "__bucket").orderBy("__n")) - 1
    out = dealt.withColumn("__seat", seat).join(before, (F.col("__shard") == F.col("__s")) & (F.col("__bucket") == F.col("__k")))
    slot = (F.col("__before") + F.col("__seat")).alias("slot")
    return out.select(*["doc"] * carry, F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__old").alias("old_shard"), F.col("__shard").alias("shard"), slot)


def rewrite(docs: DataFrame, old_shard: Column, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> list[int]:
    """Bring `path`/shard=N from the old layout to the new one, and return the shards that were written.

    Only shards that gain or lose rows are written; the files of others stay as they are, and folders of old
    shards that no row is left in are removed. `docs` may be read from `path`: what moves is first written to the
    shared folder. A column `shard` of `docs` gives way to the new one. One writer at a time; a reader may see
    rows in both places until the call returns.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns(_keys(old_shard, _row(docs, id_col), text_col, blocks))
    units = plan_blocks(keyed.select("__old", "__block", "__part", _size(text_col).alias("size")), shards)
    moved = units[units["__old"] != units["shard"]]
    touched, filled = {int(x) for x in moved["__old"]} | {int(x) for x in moved["shard"]}, {int(x) for x in units["shard"]}
    affected = sorted(touched & filled)
    placed = place(keyed, units).where(F.col("__shard").isin(affected))
    staged = stored(placed.select(*[c for c in docs.columns if c != "shard"], F.col("__shard").alias("shard")), "rewrite")
    staged.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for shard in sorted(touched - filled):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


def by_text(n: int, text_col: str = "text") -> Column:
    """A shard for each text, so that copies lie together."""
    return F.pmod(F.xxhash64(_text(text_col)), F.lit(n)).cast("int")


def laid_out(docs: DataFrame, n: int = OLD_SHARDS, text_col: str = "text") -> DataFrame:
    """`docs` as a layout of n shards in the shared folder, read back from its files.

    LAYOUT is a row's shard there, ROW its number.
    """
    path = f"{shared_folder(docs.sparkSession)}/tidechart-{uuid.uuid4().hex}/layout"
    rows = docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn(LAYOUT, by_text(n, text_col))
    return written(rows, path, LAYOUT)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = laid_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = reshard(docs, F.col(LAYOUT))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
