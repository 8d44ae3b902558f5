"""Reading raw records: the lake, streams, archives, CSV charts and published views."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidechart.functions.scoring import record_type
from tidechart.sources.pointer import published

RAW = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("kafka_ts", T.TimestampType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("dt", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_raw(spark: SparkSession, base: str, topic: str, schema: T.StructType, since: str | None = None) -> DataFrame:
    """Records of a topic, parsed, with kafka_ts and dt; days before `since` are not read. No lake, no rows."""
    if not _exists(spark, f"{base}/raw"):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("kafka_ts", T.TimestampType()), T.StructField("dt", T.StringType())]))
    raw = spark.read.schema(RAW).parquet(f"{base}/raw").where(F.col("topic") == topic)
    if since is not None:
        raw = raw.where(F.col("dt") >= since)
    return raw.select(F.from_json("value", schema).alias("v"), "kafka_ts", "dt").select("v.*", "kafka_ts", "dt")


def stream_options(kind: str, max_per_trigger: int) -> dict[str, object]:
    """What a source is given besides its own options: how much a trigger takes, and where Kafka starts and goes on."""
    if kind == "kafka":
        return {"startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": max_per_trigger}
    return {"maxFilesPerTrigger": max_per_trigger}


def event_stream(spark: SparkSession, source: dict[str, str], max_per_trigger: int, schema: T.StructType | None = None) -> DataFrame:
    """A stream of raw rows. source: options of a reader, with its format under "format" and a path under "path".

    Kafka gets starting offsets, a limit for each trigger, and goes on where data has aged out; file sources
    get a limit of files.
    """
    options = dict(source)
    kind, path = options.pop("format"), options.pop("path", None)
    reader = spark.readStream.format(kind).options(**stream_options(kind, max_per_trigger))
    if schema is not None:
        reader = reader.schema(schema)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def parse_stream(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of JSON values; bad input gives null fields."""
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def valid_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all keys and a time, with event time `ts`."""
    for k in [*keys, "ts_ms"]:
        df = df.where(F.col(k).isNotNull())
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def _line_numbers(lines: DataFrame, some: DataFrame) -> DataFrame:
    """`some` of `lines` (path, block, id, ...) with `number`, their line in the file.

    ids rise within a block; a block's first line follows those of the blocks before it, whose counts are summed up.
    """
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begins = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return some.join(begins, ["path", "block"]).withColumn("number", F.col("before") + F.col("id") - F.col("first") + 1)


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON lines: BOM and blank lines pass, envelopes open, equal records are one.

    Files are read by lines, in as many parts as Spark splits them into. errors: file, line and kind of error, as
    file:line: kind. A line that is no JSON is a JSONDecodeError, JSON that is no object a TypeError.
    """
    at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(paths).select(*at, F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("line"))
    some = lines.where(F.trim("line") != "")
    inner = F.coalesce(F.get_json_object("line", "$.value"), F.col("line"))
    opened = F.when(F.ltrim(inner).startswith("{"), inner).otherwise(F.col("line"))
    told = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = some.withColumn("v", F.from_json(opened, told, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("v").isNull() | F.col("v._corrupt").isNotNull() | ~F.ltrim("line").startswith("{")
    kind = F.when(F.try_parse_json("line").isNull(), "JSONDecodeError").otherwise("TypeError")
    numbered = _line_numbers(lines, parsed.where(bad).select("path", "block", "id", kind.alias("kind")))
    file = F.element_at(F.split("path", "/"), -1)
    errors = numbered.select(F.concat(file, F.lit(":"), F.col("number").cast("string"), F.lit(": "), F.col("kind")).alias("error"))
    records = parsed.where(~bad).select("v.*").drop("_corrupt").dropDuplicates()
    names = set(schema.names)
    if {"record_type", "action", "rank", "chart_id"} <= names:
        records = records.withColumn("record_type", record_type(F.col("record_type"), F.col("action"), F.col("rank"), F.col("chart_id")))
    return records, errors


def seed_lake(df: DataFrame, base: str, topic: Column, at_ms: Column) -> None:
    """Append records as raw rows, by topic and day of the event."""
    value = F.to_json(F.struct(*[c for c in df.columns]))
    raw = df.select(F.lit(None).cast("string").alias("key"), value.alias("value"), F.timestamp_millis(at_ms).alias("kafka_ts"), F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset"), topic.alias("topic"), F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd").alias("dt"))
    raw.write.partitionBy("topic", "dt").mode("append").parquet(f"{base}/raw")


#: Names under which chart files give their columns.
CSV_NAMES = {"rank": ["rank", "position", "#"], "title": ["track_name", "track name", "title"], "artist": ["artist_names", "artist", "artists"], "id": ["uri", "url", "id"], "streams": ["streams", "metric_value", "plays"]}


def read_chart_csv(spark: SparkSession, path: str, names: dict[str, list[str]] | None = None, head: int = 8) -> DataFrame:
    """rank, title, artist, id, streams of chart files whose header stands in one of the first lines.

    Thousands separators go; lines before the header, and those without a rank, are left out.
    """
    names = names or CSV_NAMES
    known = [x for options in names.values() for x in options]
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"^\x{FEFF}", ""), "\r?\n").alias("lines"))
    is_head = lambda x: F.size(F.array_intersect(F.transform(F.split(F.lower(F.replace(x, F.lit('"'), F.lit(""))), ","), lambda y: F.trim(y)), F.array(*[F.lit(k) for k in known]))) >= 2
    at = F.array_position(F.transform(F.slice("lines", 1, head), is_head), F.lit(True))
    found = text.withColumn("at", at).where("at > 0").withColumn("head", F.transform(F.split(F.lower(F.replace(F.element_at("lines", F.col("at").cast("int")), F.lit('"'), F.lit(""))), ","), lambda y: F.trim(y)))
    rows = found.select("file", "head", F.explode(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines"))).alias("line")).where(F.trim("line") != "")
    cells = F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    own = rows.withColumn("cells", cells)

    def cell(options: list[str]) -> Column:
        return F.coalesce(*[F.get("cells", F.array_position("head", F.lit(o)).cast("int") - 1) for o in options])

    number = lambda c: F.regexp_replace(c, r"[,.\s]", "")
    out = own.select("file", number(cell(names["rank"])).try_cast("int").alias("rank"), cell(names["title"]).alias("title"), cell(names["artist"]).alias("artist"), cell(names["id"]).alias("id"), number(cell(names["streams"])).try_cast("long").alias("streams"))
    return out.where(F.col("rank").isNotNull())


def read_view(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """The published version of a view, or None."""
    told = published(spark, f"{base}/{name}/_latest", "run_id string, at timestamp, seq int")
    return spark.read.parquet(f"{base}/{name}/run_id={max(told, key=lambda r: r['seq'])['run_id']}") if told else None


class ViewCache:
    """Published views that are read again once they are older than `ttl` seconds; each is kept in memory meanwhile.

    A view that is not published is looked for at every call. clock: seconds, for tests.
    """

    def __init__(self, spark: SparkSession, base: str, ttl: float = 300.0, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.ttl, self.clock = spark, base, ttl, clock
        self._known: dict[str, tuple[DataFrame | None, float]] = {}

    def get(self, name: str) -> DataFrame | None:
        old, read_at = self._known.get(name, (None, 0.0))
        if old is not None and self.clock() - read_at < self.ttl:
            return old
        new = read_view(self.spark, self.base, name)
        new = new.persist() if new is not None else None
        if old is not None:
            old.unpersist()
        self._known[name] = (new, self.clock())
        return new
