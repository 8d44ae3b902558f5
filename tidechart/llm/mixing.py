"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target: its share of a budget by weight, capped at a number of epochs, with the
excess shared again by weight. A source's documents are taken for as many complete epochs as its target
holds; the rest is a weighted sample without replacement: a document's key is an exponential variable
divided by its quality weight, keys are sorted within the source, and sizes are summed in that order up to
the rest of the target.

Keys come from a hash of the id and a seed, so reruns agree. Sums run over buckets of keys, so no source
has to fit a task. The table of sources is the only thing ranked in one task; it has a row for each source.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows count one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidechart.llm.common import ranked_sums, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
EPOCHS = 2.0
#: Rows of one source in a bucket of keys, on average at most.
BUCKET_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight above 0 for a text: the share of characters that belong to common prose, from 0.25 to 1."""
    n = F.greatest(F.length(text), F.lit(1))
    junk = F.length(text) - F.length(F.translate(text, "#$%&*|=<>{}[]\\^~_@0123456789!", ""))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(4.0) * junk / n), F.lit(0.25))


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target): water filling in closed form.

    Sources sorted by cap/weight fill up in that order: with the first k at their caps, the others share what
    is left by weight, and k is the least for which the next one stays below its cap.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    order = W.partitionBy().orderBy(F.col(source).asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("w", F.element_at(listed, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * epochs, "ratio": F.col("source_size") * epochs / F.col("w")})
    fill = W.partitionBy().orderBy("ratio", F.col(source).asc_nulls_last())
    earlier = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
            "open_w": F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)),
            "total": F.sum("source_size").over(W.partitionBy()) * budget,
        }
    )
    share = (F.col("total") - F.col("capped")) / F.col("open_w")
    candidate = F.when(share <= F.col("ratio"), F.struct(F.row_number().over(fill).alias("k"), share.alias("share")))
    first = rest.withColumn("candidate", candidate).withColumn("level", F.min("candidate").over(W.partitionBy())["share"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return first.select(F.col(source).alias("source"), "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, id, text_hash, source, size, source_size, target, key, taken) of every row; `taken` counts repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.md5(text)
    tag = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), mark))
    unit = (F.conv(F.substring(tag, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = docs.select(*carry, F.col(id_col).alias("id"), mark.alias("text_hash"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("weight"), unit.alias("unit"))
    rows = stored(rows.withColumn("key", -F.log("unit") / F.col("weight")), "sizes")
    targets = stored(source_targets(rows, "source", "size", weights, budget, epochs), "targets")
    told = rows.groupBy("source").agg(F.count("*").alias("n"), F.min("weight").alias("w")).agg(F.max("n").alias("n"), F.min("w").alias("w")).first()
    buckets = max(1, -(-(told["n"] or 0) // BUCKET_ROWS))
    # 1 - exp(-key * w) rises with the key and lies in [0, 1). With the least weight as w it is uniform for that
    # weight and at most weight / w times as dense for others, so no bucket stands out.
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key") * (told["w"] or 1.0))) * buckets), F.lit(buckets - 1)).cast("int"))
    summed = ranked_sums(rows, ["source"], "bucket", [F.col("key"), F.col("id"), F.col("text_hash")], {"before": "size"})
    goal = targets.withColumnRenamed("source", "__s")
    joined = summed.join(goal, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    complete = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - complete * F.col("source_size")
    # a document belongs to the fraction if most of it does, so the sum ends within half a document of the target
    inside = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2.0 <= rest)
    return joined.select(*carry, "id", "text_hash", "source", "size", "source_size", "target", "key", (F.col("size") * (complete + inside.cast("int"))).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), n_words(F.col("text")), quality(F.col("text")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")
