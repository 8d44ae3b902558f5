"""Benchmark decontamination by a distributed positional inverted index.

One scan of the texts stores postings (term, document, position) of every term that some phrase asks for, and of the
end of each text. All that follows reads them: document frequencies, numbers of words, and the lists of the two
rarest terms of each phrase. A posting of term t at position p, t being word o of a phrase, says that the phrase may
start at p - o; the two lists, so adjusted, are joined on phrase, document and start. Starts that both lists hold are
then checked word by word against a slice of the text, since postings hold terms as 64-bit hashes.

All of it is DataFrame functions. Tables made of the benchmark are broadcast only under a checked number of
rows; beyond it they are joined by shuffles, of which none carries more of a text than a phrase's words, but for the
one that brings texts to the starts in them.

Defined cases: a null text has no words; items or documents without words match nothing; items with equal phrases
each count; an item without id cannot be listed or counted, but its windows hit; of terms that are equally rare, the
one that stands first in the phrase comes first; repeated documents are answered one by one; very long texts are
read whole; empty tables give no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import lower_ascii, numbered, stored, table

WINDOW = 10
#: Rows of a benchmark-side table that may be broadcast; about 100 bytes each.
BROADCAST_ROWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What the index holds at the end of each text; no word is a line break.
END = "\n"


def words(text: Column) -> Column:
    """Words of a text as an array: runs of 0-9, a-z and all beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase_id, phrase, items): distinct word windows and the items that hold them. A short item is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - window, F.lit(0))
    each = w.select("item", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("w", i + 1, window))).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item").alias("items")).withColumn("phrase_id", F.xxhash64("phrase"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, stored: (term, uid, pos) of every word of `docs` (uid, text) that `terms` (term) lists, and of ends.

    Terms are hashes of words. The posting of a text's end has the number of its words as its position.
    """
    own = terms.select(F.xxhash64("term").alias("term")).unionByName(terms.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"))).distinct()
    each = docs.select("uid", F.posexplode(F.array_append(words(F.col("text")), F.lit(END))).alias("pos", "word"))
    found = each.select(F.xxhash64("word").alias("term"), "uid", "pos")
    return stored(found.join(small(stored(own, "terms")), "term"), "postings")


def word_counts(index: DataFrame) -> DataFrame:
    """(uid, n_words) of every document."""
    return index.where(F.col("term") == F.xxhash64(F.lit(END))).select("uid", F.col("pos").cast("long").alias("n_words"))


def phrase_starts(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, phrase_id, start): where the lists of a phrase's two rarest terms agree. asked: phrase_id, phrase."""
    slots = asked.select("phrase_id", F.posexplode("phrase").alias("off", "word")).select("phrase_id", "off", F.xxhash64("word").alias("term"))
    lists = stored(index.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    cost = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term")
    by_df = F.array_sort(F.collect_list(cost)).alias("by_df")
    ordered = slots.join(lists, "term", "left").groupBy("phrase_id").agg(by_df).where(F.col("by_df")[0]["df"] > 0)
    # the two rarest terms of each phrase; a one-word phrase has one
    rarest = stored(ordered.select("phrase_id", F.slice("by_df", 1, 2).alias("by_df")), "rarest")

    def places(k: int, *more: Column) -> DataFrame:
        own = rarest.where(F.size("by_df") > k).select("phrase_id", F.col("by_df")[k]["term"].alias("term"), F.col("by_df")[k]["off"].alias("off"), *more)
        hits = index.join(small(own), "term").withColumn("start", F.col("pos") - F.col("off"))
        return hits.where(F.col("start") >= 0).drop("term", "pos", "off")

    both = places(0, (F.size("by_df") == 1).alias("alone")).join(places(1).withColumn("agreed", F.lit(True)), ["uid", "phrase_id", "start"], "left")
    return both.where(F.col("alone") | F.col("agreed")).select("uid", "phrase_id", "start")


def phrase_matches(docs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, phrase_id, start, n, items): all exact phrase matches. docs: uid, text, as `index` has them.

    Texts meet their candidates as texts, and are cut into words after that: words take twice the room.
    """
    starts = phrase_starts(index, asked).join(small(asked.select("phrase_id", F.size("phrase").alias("n"))), "phrase_id")
    by_doc = starts.groupBy("uid").agg(F.collect_list(F.struct("start", "phrase_id", "n")).alias("cand"))
    texts = docs.select(F.col("uid").alias("__u"), "text")
    near = by_doc.join(texts, F.col("uid") == F.col("__u")).select("uid", "cand", words(F.col("text")).alias("w"))
    cut = F.transform("cand", lambda c: F.struct(c["phrase_id"].alias("phrase_id"), c["start"].alias("start"), F.slice("w", c["start"] + 1, c["n"]).alias("found")))
    found = near.select("uid", F.explode(cut).alias("c")).select("uid", "c.phrase_id", "c.start", "c.found")
    checked = found.join(small(asked), "phrase_id").where(F.col("found") == F.col("phrase"))
    return checked.select("uid", "phrase_id", "start", F.size("phrase").alias("n"), "items")


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(uid, pair_id, a_pos, b_pos): places where term_b follows or precedes term_a by 1 to `within` words.

    pairs: pair_id, term_a, term_b. Lists of both terms meet in blocks of `within` positions, so a list is only
    compared with neighbouring blocks of the other. Within less than one word there is nothing. Terms are compared
    by their hashes.
    """
    block = F.floor(F.col("pos") / max(within, 1)).cast("int")
    one = pairs.select("pair_id", F.xxhash64("term_a").alias("term"))
    two = pairs.select("pair_id", F.xxhash64("term_b").alias("term"))
    around = F.explode(F.array(block - 1, block, block + 1)).alias("block")
    a = index.join(small(one), "term").select("pair_id", "uid", F.col("pos").alias("a_pos"), around)
    b = index.join(small(two), "term").select("pair_id", "uid", F.col("pos").alias("b_pos"), block.alias("block"))
    apart = F.abs(F.col("a_pos") - F.col("b_pos"))
    near = a.join(b, ["pair_id", "uid", "block"]).where((apart <= within) & (apart > 0))
    return near.select("uid", "pair_id", "a_pos", "b_pos")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, n_words, n_hit, item_ids) of every row of `docs` (uid, text)."""
    asked = stored(phrases(items, window=window), "phrases")
    index = postings(docs, asked.select(F.explode("phrase").alias("term")))
    covered = phrase_matches(docs.select("uid", "text"), index, asked)
    by_doc = covered.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(state: Column, run: Column) -> Column:
        end = F.greatest(state["end"], run["start"] + run["n"])
        return F.struct(end.alias("end"), (state["hit"] + end - F.greatest(state["end"], run["start"])).alias("hit"))

    hit = F.aggregate("runs", start, add, lambda s: s["hit"])
    marks = by_doc.select(F.col("uid").alias("__u"), hit.alias("n_hit"), "item_ids")
    none = F.array().cast("array<string>")
    joined = word_counts(index).join(marks, F.col("uid") == F.col("__u"), "left")
    return joined.select("uid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents"))
    found = contamination(docs, table(spark, sf_dir, "benchmark")).join(docs.select(F.col("uid").alias("__row"), "id"), F.col("uid") == F.col("__row"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
