"""Substring search by an index of letter runs that is stored beside a catalog.

An index has two tables: `postings` (run, key), in order of run and key, one row for each run of one to RUN letters of
an entry's text; and `sizes` (run, n), how many keys hold a run. A query is looked up by its rarest runs, so only the
lists of those are read, and texts are compared only where all of them meet. Runs shorter than RUN are there for
queries that are.

Texts and queries are compared as `norm_text` leaves the query; the catalog's column holds normalised text. Entries with
a null text hold nothing; an empty query is held by all others. Keys may repeat or be null. An index that is older than
its catalog misses entries but finds none wrongly: publish it first.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.functions.text import norm_text
from tidechart.operators.materialize import materialized
from tidechart.operators.ranking import top_n
from tidechart.sources.lake import read_view
from tidechart.sources.sinks import write_view

#: Letters of a run, and how many of a query's lists are intersected before texts are compared.
RUN, LISTS = 3, 2
#: Entries whose runs one task makes.
ENTRIES = 50_000


@dataclass
class SearchIndex:
    postings: DataFrame
    sizes: DataFrame


def _runs_of(text: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))


def letter_runs(catalog: DataFrame, text: str, key: str) -> DataFrame:
    """run, key: the runs of one to RUN letters of each entry, once each. A run that all hold is spread by key."""
    runs = F.array_distinct(F.concat(*[_runs_of(text, n) for n in range(1, RUN + 1)]))
    parts = max(1, -(-catalog.count() // ENTRIES))
    own = catalog.select(F.col(text), F.col(key).alias("key")).repartition(parts, "key")
    rows = own.select(F.explode(runs).alias("run"), "key").where("run <> ''").distinct()
    return rows.repartitionByRange(parts, "run", "key").sortWithinPartitions("run", "key")


def run_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("run").agg(F.count("*").alias("n"))


def build_index(catalog: DataFrame, text: str, key: str) -> SearchIndex:
    """An index in the session's shared folder."""
    postings = materialized(letter_runs(catalog, text, key), "runs")
    return SearchIndex(postings, materialized(run_sizes(postings), "sizes"))


def publish_index(catalog: DataFrame, base: str, name: str, text: str, key: str, run_id: str, at: datetime) -> None:
    """Write an index as versions of two views, named after the catalog's."""
    write_view(letter_runs(catalog, text, key), base, f"{name}_runs", run_id, at)
    write_view(run_sizes(read_view(catalog.sparkSession, base, f"{name}_runs")), base, f"{name}_run_sizes", run_id, at)


def read_index(spark: SparkSession, base: str, name: str) -> SearchIndex | None:
    """The published index of a catalog, or None."""
    postings, sizes = read_view(spark, base, f"{name}_runs"), read_view(spark, base, f"{name}_run_sizes")
    return SearchIndex(postings, sizes) if postings is not None and sizes is not None else None


def search_indexed(catalog: DataFrame, index: SearchIndex, q: str, text: str, score: str, key: str, n: int = 20) -> DataFrame:
    """The rows of `serving.search`, found through the index: entries that hold the query, most popular first."""
    order = [F.desc_nulls_last(score), F.col(key)]
    norm = catalog.sparkSession.range(1).select(norm_text(F.lit(q)).alias("q")).first()["q"]
    if not norm:
        return catalog.where(F.col(text).isNotNull()).orderBy(*order).limit(n)
    runs = sorted({norm[i : i + RUN] for i in range(max(1, len(norm) - RUN + 1))})
    # a row for each run of the query
    many = {r["run"]: r["n"] for r in index.sizes.where(F.col("run").isin(runs)).collect()}
    if len(many) < len(runs):
        return catalog.limit(0)
    rarest = sorted(runs, key=lambda r: (many[r], r))[:LISTS]
    held = index.postings.where(F.col("run") == rarest[0]).select("key")
    for run in rarest[1:]:
        other = index.postings.where(F.col("run") == run).select(F.col("key").alias("other"))
        held = held.join(other, F.col("key").eqNullSafe(F.col("other")), "left_semi")
    held = held.select(F.col("key").alias("__held"))
    found = catalog.join(held, catalog[key].eqNullSafe(held["__held"]), "left_semi").where(F.contains(F.col(text), F.lit(norm)))
    return found.orderBy(*order).limit(n)


def search_many(catalog: DataFrame, index: SearchIndex, queries: DataFrame, text: str, score: str, key: str, n: int = 20) -> DataFrame:
    """q, rank and the catalog's columns: the n first entries of each distinct query of `queries` (q).

    A query meets the entries of its rarest run alone. Queries that come to the same text are looked up once.
    """
    asked = queries.select("q").where(F.col("q").isNotNull()).distinct().withColumn("norm", norm_text(F.col("q")))
    runs = asked.where("norm <> ''").select("norm").distinct().select("norm", F.explode(F.array_distinct(_runs_of("norm", RUN))).alias("run"))
    sized = runs.join(index.sizes, "run", "left")
    rarest = sized.groupBy("norm").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0")
    held = rarest.join(index.postings, "run").select("norm", F.col("key").alias("__held"))
    own = catalog.where(F.col(text).isNotNull())
    met = held.join(own, held["__held"].eqNullSafe(own[key])).where(F.contains(F.col(text), F.col("norm"))).drop("__held")
    order = [F.desc_nulls_last(score), F.col(key)]
    # n rows, for queries that every entry holds
    first = own.orderBy(*order).limit(n).withColumn("norm", F.lit(""))
    best = top_n(met, ["norm"], order, n).unionByName(top_n(first, ["norm"], order, n))
    return asked.join(best, "norm").drop("norm")
