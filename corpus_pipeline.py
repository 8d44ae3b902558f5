"""A pipeline over documents: toxicity, near duplicates, benchmark passages, source mix, shards.

Every stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a DataFrame.
run() writes each stage's rows to the shared folder and reads them back for the next.

Defined cases, in every stage: documents with a null or empty text have no features, no shingles, no benchmark
words and size 0, so they pass the first three stages, and the mix, which takes words, leaves them out; very long
texts are read whole; null ids and repeated rows are kept apart by row numbers, so one of several equal texts
stays whatever their ids, and of near copies the one with the least id (null last); an empty table passes through
all stages as an empty table; columns that documents have beyond the usual ones come through as they are, unless
they have the name of a column that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import stored, table, with_uid
from tidechart.llm.decontamination import contamination
from tidechart.llm.jaccard_join import joined
from tidechart.llm.mixing import mix, n_words, quality
from tidechart.llm.sharding import LAYOUT, laid_out, reshard
from tidechart.llm.toxicity import accepted, trained

#: Near duplicates share at least 8/10 of their five-word shingles; op3's contract (3 words, 9/10) is not the stage's.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 8, 10

#: Columns that the last stage adds; columns of documents by these names give way.
PLACED = ("size", "text_crc32", "law", "shard", "slot", "old_shard")

#: The stages train and sample, which SQL does not express; tests hold them against plain versions.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("__uid").alias("uid"), F.col("doc_id").alias("id"), "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    return accepted(docs, trained(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates (5-word similarity of 0.8 or more); documents without words all stay."""
    numbered = with_uid(docs)
    gone = joined(_rows(numbered), NEAR_WORDS, NEAR_NUM, NEAR_DEN).where(~F.col("kept")).select(F.col("uid").alias("__uid"))
    return numbered.join(gone, "__uid", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    numbered = with_uid(docs)
    found = contamination(_rows(numbered), table(spark, sf_dir, "benchmark"))
    gone = found.where(F.col("n_hit") > 0).select(F.col("uid").alias("__uid"))
    return numbered.join(gone, "__uid", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each epoch, none if it is left out."""
    numbered = with_uid(docs)
    taken = mix(numbered, n_words(F.col("text")), quality(F.col("text")), carry=("__uid",)).where(F.col("taken") > 0)
    times = taken.select("__uid", F.expr("int(taken div size)").alias("__times"))
    repeated = numbered.join(times, "__uid").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in shards: the columns of documents, and size, text_crc32, law, shard, slot and old_shard of every row."""
    placed = reshard(laid_out(docs.drop(*PLACED)), F.col(LAYOUT), carry=True)
    return placed.select("doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "old_shard")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
