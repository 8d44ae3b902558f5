"""The raw lake as a stream with offsets of its own, for replays without the broker that filled it.

Files of a topic come in order of (time of change, path); an offset is the last of them that was taken. A query that
starts again reads on behind its checkpoint's offset, and a batch that failed is made of the same files again. Files
that changed within the last `settle` seconds wait, so none can come in behind an offset later. A trigger takes all
files that have settled; where batches have to be bounded, `event_stream` over Parquet has a limit of files.

Each file is a partition and goes to Spark in Arrow batches; only names and times of files pass through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidechart.shipping import ship

FIELDS = "topic string, dt string, key string, value string, kafka_ts timestamp, partition int, offset long"
START = {"at": -1, "path": ""}


@dataclass
class LakeFile(InputPartition):
    path: str
    dt: str


def _place(offset: dict) -> tuple[int, str]:
    return int(offset["at"]), offset["path"]


class LakeReader(DataSourceStreamReader):
    def __init__(self, path: str, topic: str, since: str, settle: float):
        self.path, self.topic, self.since, self.settle = path, topic, since, settle

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _files(self) -> list[tuple[int, str, str]]:
        """(time of change, path, day) of the topic's files from `since` on, in order."""
        from pyarrow import fs

        system, root = self._fs()
        found = []
        for day in system.get_file_info(fs.FileSelector(f"{root}/raw/topic={self.topic}", allow_not_found=True)):
            dt = unquote(day.base_name.removeprefix("dt="))
            if day.base_name.startswith("dt=") and dt >= self.since:
                inside = system.get_file_info(fs.FileSelector(day.path))
                found += [(f.mtime_ns, f.path, dt) for f in inside if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._"]
        return sorted(found)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        settled = [f for f in self._files() if f[0] <= (time.time() - self.settle) * 1e9]
        return {"at": settled[-1][0], "path": settled[-1][1]} if settled else dict(START)

    def partitions(self, start: dict, end: dict) -> list[LakeFile]:
        return [LakeFile(path, dt) for at, path, dt in self._files() if _place(start) < (at, path) <= _place(end)]

    def read(self, partition: LakeFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = {"key": pa.string(), "value": pa.string(), "kafka_ts": pa.timestamp("us", tz="UTC"), "partition": pa.int32(), "offset": pa.int64()}
        with self._fs()[0].open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096, columns=list(kinds)):
                same = [pa.repeat(pa.scalar(x, pa.string()), len(batch)) for x in (self.topic, partition.dt)]
                yield pa.RecordBatch.from_arrays([*same, *[batch.column(c).cast(k) for c, k in kinds.items()]], ["topic", "dt", *kinds])


class LakeReplay(DataSource):
    """Options: path (of the lake, with a scheme), topic, since (a day), settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "lake_replay"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema) -> LakeReader:
        return LakeReader(self.options["path"], self.options["topic"], self.options.get("since", ""), float(self.options.get("settle", 2)))


def replay(spark: SparkSession, base: str, topic: str, since: str | None = None, settle: float = 2.0) -> DataFrame:
    """A stream of a topic's raw rows: topic, dt, key, value, kafka_ts, partition, offset."""
    ship(spark)
    spark.dataSource.register(LakeReplay)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    return spark.readStream.format("lake_replay").option("path", full).option("topic", topic).option("since", since or "").option("settle", settle).load()
