"""Secret scans over an incremental ledger of blobs.

Every distinct text is a blob, addressed by its SHA-256. A ledger holds one row for each blob and rule
version that was scanned, with its findings. A run scans only blob and rule-version pairs that the ledger
lacks, then joins findings back to every row (path) that holds the blob. All of it is DataFrame functions.

A ledger lasts: `update_ledger` appends what a run has scanned, and the next run starts from it.

Defined cases: a null text is the empty blob; empty tables give empty results; rows with equal ids or equal
texts are kept one by one; of spans that start together the rule listed first comes first; a very long text,
or one with very many matches, is scanned whole, at a cost in proportion; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.llm.common import table
from tidechart.operators.materialize import shared_folder

SPANS = "array<struct<start:int,at:int,kind:string,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `keep` is the least length of `group`; shorter matches are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    keep: int = 0
    #: A cheap literal or pattern that a text needs to hold for any match; spares the rest.
    needs: str = ""


#: In the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA[A-Z0-9]"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 0, "PRIVATE KEY"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def rule_parts(text: Column, rule: Rule) -> Column:
    """Array of (n, gap, kept) by match: its length, the text before it since the last match, the length that counts.

    The text after the last match comes as one more entry, without n and kept.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.keep else found
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    parts = F.arrays_zip(found.alias("n"), between.alias("gap"), kept.alias("kept"))
    return F.when(text.rlike(rule.needs), parts) if rule.needs else parts


def with_blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text): the address of each row's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the blob and rule-version pairs that `ledger` lacks.

    One row of each blob is scanned. Rows are chosen by blob and path (its hash) before any text moves, and copies
    meet in the partial aggregation, so a text that a third of all rows hold costs no more than another; rows that
    repeat a chosen path are one again where the join has put them, before the scan. Places are running sums over a blob's matches, so the
    cost of a text follows its length.
    """
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    chosen = versions.select("blob", F.xxhash64("path").alias("row")).groupBy("blob").agg(F.min("row").alias("row"))
    if ledger is None:
        todo = chosen.select("blob", "row", wanted.alias("todo"))
    else:
        pairs = chosen.select("blob", "row", F.explode(wanted).alias("r")).select("blob", "row", "r.kind", "r.version")
        unseen = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        todo = unseen.groupBy("blob", "row").agg(F.collect_list(F.struct("kind", "version")).alias("todo"))
    texts = versions.select(F.col("blob").alias("__b"), F.xxhash64("path").alias("__r"), "text")
    met = todo.join(texts, (F.col("blob") == F.col("__b")) & (F.col("row") == F.col("__r")))
    chosen = met.dropDuplicates(["blob", "row"]).select("blob", "todo", "text")
    due = lambda r: F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
    each = F.array(
        *[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(k).alias("at"), F.lit(r.keep).alias("keep"), F.when(due(r), rule_parts(F.col("text"), r)).alias("parts"), due(r).alias("due"))
            for k, r in enumerate(rules)
        ]
    )
    pairs = chosen.select("blob", F.explode(each).alias("f")).where("f.due").select("blob", "f.kind", "f.version", "f.at", "f.keep", "f.parts")
    opened = pairs.select("blob", "kind", "version", "at", "keep", F.posexplode_outer("parts").alias("i", "p"))
    upto = W.partitionBy("blob", "kind", "version").orderBy("i")
    placed = opened.withColumn("end", F.sum(F.col("p.gap") + F.col("p.n")).over(upto).cast("int"))
    span = F.struct((F.col("end") - F.col("p.n")).alias("start"), "at", "kind", "end")
    # collect_list leaves nulls out: matches that are too short fall away, their pair stays
    taken = F.collect_list(F.when(F.col("p.kept") >= F.col("keep"), span))
    return placed.groupBy("blob", "kind", "version").agg(F.array_sort(taken).cast(SPANS).alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at `path` after a scan of what it lacks, which is appended to it. No ledger there: an empty one.

    A pair that is in the ledger is never scanned again, by this run or a later one; a run that dies has appended
    nothing or all. One writer at a time.
    """
    spark = versions.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    ledger = spark.read.schema(LEDGER).parquet(path) if there else None
    scan_unseen(versions, ledger, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): every path with all spans of its blob by `rules`, in order of start, then kind."""
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    now = ledger.where(F.size("spans") > 0).where(F.array_contains(asked, F.struct("kind", "version")))
    spans = now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return versions.select("path", "blob").join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = with_blobs(table(spark, sf_dir, "documents"))
    at = f"{shared_folder(spark)}/tidechart-ledger-{uuid.uuid4().hex}"
    # two turns on one ledger, as sources come in: the second scans only blobs that the first, the smallest, lacks
    docs = table(spark, sf_dir, "documents")
    least = docs.groupBy("source").count().orderBy("count", "source").limit(1).select("source").collect()
    update_ledger(with_blobs(docs.where(F.col("source").eqNullSafe(least[0][0] if least else None))), at)
    found = findings(versions, update_ledger(versions, at))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["at"] < len(BASE_RULES))
    return found.select(
        F.col("path").alias("doc_id"),
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
