"""Keyed tables: rows by id, a later write overwriting, by deltas that are merged as they are read.

A table is dealt out over hash buckets of the id. A write adds one file of what came in to each bucket that it touches
and nothing else; a reader takes the newest row of each id over the files of a bucket. Files are merged once a bucket
has more than RUN of them: the newest ones, as far back as they are not much smaller than the next older one, so a
row is written again as often as the logarithm of the table's size over the write's. A table that has grown is dealt
out over twice as many buckets.

A manifest of files turns in one step: readers and a crash in between see the table of before. Files that a write
replaces are marked in it and deleted by the next write, so readers that have begun keep theirs; folders that no
manifest knows are what a crash left, and go as well. One writer at a time.

Defined cases: a null id is an error, and then nothing is written; rows of one id in one write are one, the greatest
in order, ties by their other columns; a null order value is the least; an empty write changes nothing; columns may
come and go, and are null where a write lacks them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidechart.operators.snapshots import dedup
from tidechart.sources.pointer import delete, folders, publish, published, size_of

#: Buckets of a new table; one whose buckets hold more than BUCKET_BYTES on average gets twice as many.
BUCKETS, BUCKET_BYTES = 16, 256 << 20
#: Files of a bucket before the newest are merged, and how many times their bytes the next older may have to be merged too.
RUN, REACH = 8, 2
TABLE = "bucket int, buckets int, path string, bytes long, turn long, live boolean, id string, ord string"


def _dealt(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.withColumn("__bucket", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))


def _newest(df: DataFrame, by: list[str], order_col: str) -> DataFrame:
    return dedup(df, by, [F.desc(order_col), F.desc("__turn")])


def _put(df: DataFrame, id_col: str, order_col: str, path: str) -> dict[int, str]:
    """The newest row of each id of `df` (with __bucket), in a folder for each bucket. One shuffle serves both."""
    own = _newest(df.repartition("__bucket"), ["__bucket", id_col], order_col)
    own.write.partitionBy("__bucket").parquet(path)
    return {int(name.split("=")[1]): f"{path}/{name}" for name in folders(df.sparkSession, path) if name.startswith("__bucket=")}


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def _run(files: list[Row], limit: int) -> list[Row]:
    """The files of a bucket to merge: none up to `limit`, else the newest up to one that is much larger than they."""
    if len(files) <= limit:
        return []
    newest = sorted(files, key=lambda r: -r["turn"])
    taken, held = newest[:2], newest[0]["bytes"] + newest[1]["bytes"]
    for r in newest[2:]:
        if r["bytes"] > REACH * held:
            break
        taken.append(r)
        held += r["bytes"]
    return taken


def upsert(df: DataFrame, base: str, name: str, id_col: str, order_col: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES, run: int = RUN) -> None:
    """Add rows: the greatest `order_col` of an id wins, and of equal ones the row written last.

    So a replayed batch changes nothing, and a corrected row takes its place.
    """
    spark, root = df.sparkSession, f"{base}/{name}"
    known = published(spark, f"{root}/_manifest", TABLE)
    live = [r for r in known if r["live"]]
    if live and (live[0]["id"], live[0]["ord"]) != (id_col, order_col):
        raise ValueError(f"{root} has its rows by {live[0]['id']} in order of {live[0]['ord']}")
    n, turn = (live[0]["buckets"] if live else buckets), max((r["turn"] for r in known), default=0) + 1
    own = f"{root}/data/{uuid.uuid4().hex}"
    there = F.when(F.col(id_col).isNull(), F.raise_error(F.lit(f"a row for {root} has no {id_col}"))).otherwise(F.col(id_col))
    came = _put(_dealt(df.withColumns({id_col: there, "__turn": F.lit(turn).cast("long")}), id_col, n), id_col, order_col, f"{own}/new")
    if not came:
        delete(spark, own)
        return
    entry = lambda bucket, path, of, turn: Row(bucket=bucket, buckets=of, path=path, bytes=size_of(spark, path), turn=turn, live=True, id=id_col, ord=order_col)
    now = [*live, *[entry(k, path, n, turn) for k, path in sorted(came.items())]]
    if sum(r["bytes"] for r in now) > n * bucket_bytes:
        old, n = now, 2 * n
    else:
        old = [r for k in came for r in _run([x for x in now if x["bucket"] == k], run)]
    if old:
        merged = _put(_dealt(_read(spark, [r["path"] for r in old]), id_col, n), id_col, order_col, f"{own}/merged")
        gone = {r["path"] for r in old}
        latest = {k: max((r["turn"] for r in old if r["bucket"] == k), default=turn) for k in merged} if n == old[0]["buckets"] else dict.fromkeys(merged, turn)
        now = [r for r in now if r["path"] not in gone] + [entry(k, path, n, latest[k]) for k, path in sorted(merged.items())]
    replaced = {r["path"] for r in live} - {r["path"] for r in now}
    dead = [Row(**{**r.asDict(), "live": False}) for r in live if r["path"] in replaced]
    publish(spark.createDataFrame([*now, *dead], TABLE), f"{root}/_manifest")
    # what the manifest before had replaced has no readers left, and what was merged at once never had any
    for path in [*[r["path"] for r in known if not r["live"]], *({*came.values()} - {r["path"] for r in now})]:
        delete(spark, path)
    referred = {r["path"].removeprefix(f"{root}/data/").split("/")[0] for r in [*now, *dead]}
    for left in set(folders(spark, f"{root}/data")) - referred:
        delete(spark, f"{root}/data/{left}")


def has_table(spark: SparkSession, base: str, name: str) -> bool:
    return bool(published(spark, f"{base}/{name}/_manifest", TABLE))


def read_upserted(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The newest row of each id. Buckets of one file are read as they are; only the others are merged."""
    live = [r for r in published(spark, f"{base}/{name}/_manifest", TABLE) if r["live"]]
    if not live:
        raise FileNotFoundError(f"no table at {base}/{name}")
    count = {k: sum(r["bucket"] == k for r in live) for k in {r["bucket"] for r in live}}
    parts = []
    if single := [r["path"] for r in live if count[r["bucket"]] == 1]:
        parts.append(_read(spark, single))
    if several := [r["path"] for r in live if count[r["bucket"]] > 1]:
        parts.append(_newest(_read(spark, several), [live[0]["id"]], live[0]["ord"]))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return whole.drop("__turn")


def record_id() -> Column:
    """topic:partition:offset, the same for a record however often it is read; null if one of them is."""
    return F.concat("topic", F.lit(":"), F.col("partition").cast("string"), F.lit(":"), F.col("offset").cast("string"))
