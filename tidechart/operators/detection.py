"""Finding dictionary terms in texts, and what a mention says about its writer.

Each name meets the texts by its rarest word alone, so a word that many names share costs nothing. Spark chooses the
join; nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidechart.functions.text import has_diacritics, light_text, norm_text

# Phrases before and after a name by which writers say that they are from there, and words of
# credits; without accents.
SELF_BEFORE = r"(?:^|\s)(?:que|que huong|nguoi|dan|gai|trai|den tu|gui tu|(?:ai|minh|toi|tui|em|to|mk|t|tao|bon minh|chung minh|nha minh|nha em)(?: dang| hien| cung| van)?(?: (?:o|tai|tu|song o|song tai|lam o|hoc o|den tu|gui tu))?)$"
SELF_NEAR = r"(?:^|\s)que(?: huong)?(?:\s+\S+){0,3}$"
SELF_AFTER = r"^(?:diem danh|dau|ne|nhe|day|co ai|que toi|que minh|que em|que tui|la que|cua toi|cua minh|minh day|here)(?:\s|$)|^(?:luon|nua)\s*$"
CREDIT_WORDS = r"\b(credit|credits|director|producer|executive|production|stylist|makeup|make up|choreograph\w*|dao dien|san xuat|bien dao|phoi khi|hoa am|quay tai|location|mixing|mastering|composer|sang tac|art director|dop)\b"
# End of fixed values.


def aliases(names: DataFrame, name: str, code: str, ambiguous: list[str]) -> DataFrame:
    """(gram, accented, code): names as they are looked up, with accents, and without unless ambiguous so."""
    own = names.select(light_text(F.col(name)).alias("light"), F.col(code).alias("code"))
    plain = norm_text(F.col("light"))
    with_, without = own.select(F.col("light").alias("gram"), F.lit(True).alias("accented"), "code"), own.select(plain.alias("gram"), F.lit(False).alias("accented"), "code")
    return with_.unionByName(without.where(~F.col("gram").isin(ambiguous)) if ambiguous else without).where("gram != ''").distinct()


#: Words of a text between two places whose character offsets are kept.
STRIDE = 256


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are worked out once a row, also where later expressions use them again and again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _normal(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, accented, words of the normalised text: with accents if it has some, else plain. Texts without words go."""
    lit = docs.select(doc, light_text(F.col(text)).alias("light")).withColumn("accented", has_diacritics(F.col("light")))
    own = lit.select(doc, "accented", F.when(F.col("accented"), F.col("light")).otherwise(norm_text(F.col("light"))).alias("target")).where("target != ''")
    return once(own, words=F.split("target", " ")).drop("target")


def word_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """accented, word, n: how often texts have each word."""
    return _normal(docs, doc, text).select("accented", F.explode("words").alias("word")).groupBy("accented", "word").agg(F.count("*").alias("n"))


def anchors(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, accented, codes, word, k: each name by its word that texts have least often, its k-th from 0.

    Names of which texts lack a word are left out, since they stand nowhere.
    """
    names = terms.groupBy("gram", "accented").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    parts = names.select("gram", "accented", "codes", F.posexplode(F.split("gram", " ")).alias("k", "word"))
    counted = parts.join(counts, ["accented", "word"], "left")
    rarest = counted.groupBy("gram", "accented", "codes").agg(F.min_by(F.struct("word", "k"), F.struct("n", "k")).alias("a"), F.count_if(F.col("n").isNull()).alias("absent"))
    return rarest.where("absent = 0").select("gram", "accented", "codes", "a.word", "a.k")


def term_matches(docs: DataFrame, doc: str, text: str, terms: DataFrame, ctx: int = 30, counts: DataFrame | None = None) -> DataFrame:
    """doc, code, start, end, lead, tail: each place where a name stands in a text, whatever its number of words.

    A text with accents is compared with accented names, one without with plain names. A name is looked for where its
    rarest word stands, so the rows of the join follow the rarest words of names; its other words are then compared in
    place, in the one row that brings a text and its places together. start and end are character offsets in the
    normalised text, lead and tail the `ctx` characters before and after. doc: unique. counts: as of word_counts, for a
    caller who knows them; any counts of all words find the same.
    """
    own = _normal(docs, doc, text)
    places = own.select(doc, "accented", F.posexplode("words").alias("i", "word"))
    named = anchors(terms, word_counts(docs, doc, text) if counts is None else counts)
    met = places.join(named, ["accented", "word"]).where("i >= k").select(doc, F.struct((F.col("i") - F.col("k")).alias("at"), "gram", F.size(F.split("gram", " ")).alias("n"), "codes").alias("c"))
    by_doc = met.groupBy(doc).agg(F.collect_list("c").alias("met"))
    stands = lambda c: F.array_join(F.slice("words", c["at"] + 1, c["n"]), " ") == c["gram"]
    found = own.select(doc, "words").join(by_doc, doc).withColumn("found", F.filter("met", stands)).where(F.size("found") > 0).drop("met")
    # where every STRIDE-th word begins, so that an offset is told from there on
    strides = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int"))
    joined = lambda start, n: F.array_join(F.slice("words", start + 1, n), " ")
    long = once(found, lengths=F.transform(strides, lambda b: F.length(joined(b * STRIDE, F.lit(STRIDE))) + 1))
    begins = once(long, begins=F.transform(strides, lambda b: F.aggregate(F.slice("lengths", F.lit(1), b), F.lit(0), lambda x, y: x + y)))
    each = begins.select(doc, "words", "begins", F.inline("found"))
    rest = F.col("at") % STRIDE
    start = F.get("begins", F.floor(F.col("at") / STRIDE).cast("int")) + F.length(joined(F.col("at") - rest, rest)) + F.when(rest > 0, 1).otherwise(0)
    # a word has a letter at least, so so many words hold ctx characters
    first = F.greatest(F.col("at") - ctx, F.lit(0))
    lead = F.when(F.col("at") > 0, F.right(F.concat(joined(first, F.col("at") - first), F.lit(" ")), F.lit(ctx))).otherwise("")
    after = F.col("at") + F.col("n")
    tail = F.when(after < F.size("words"), F.left(F.concat(F.lit(" "), joined(after, F.lit(ctx))), F.lit(ctx))).otherwise("")
    told = each.select(doc, "codes", start.alias("start"), F.length("gram").alias("size"), lead.alias("lead"), tail.alias("tail"))
    return told.select(doc, F.explode("codes").alias("code"), "start", (F.col("start") + F.col("size")).alias("end"), "lead", "tail")


def mention_kind(matches: DataFrame, before: str = SELF_BEFORE, near: str = SELF_NEAR, after: str = SELF_AFTER) -> DataFrame:
    """Matches with kind: 'self' if the text around says that the writer is from there, else 'mention'."""
    lead, tail = norm_text(F.col("lead")), norm_text(F.col("tail"))
    own = lead.rlike(before) | lead.rlike(near) | tail.rlike(after)
    return matches.withColumn("kind", F.when(own, "self").otherwise("mention"))


def is_credit_or_lyrics(text: Column, max_newlines: int = 3) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce((lines > max_newlines) | norm_text(text).rlike(CREDIT_WORDS), F.lit(False))


def drop_credit_or_lyrics(df: DataFrame, text: str, max_newlines: int = 3) -> DataFrame:
    return df.where(~is_credit_or_lyrics(F.col(text), max_newlines))


def drop_in_title(matches: DataFrame, title_matches: DataFrame, doc: str) -> DataFrame:
    """Matches whose name does not stand in the document's own title."""
    return matches.join(title_matches.select(doc, "code"), [doc, "code"], "left_anti")


def mention_weight(kind: Column, weights: tuple[float, float] = (1.0, 0.3)) -> Column:
    return F.when(kind == "self", weights[0]).otherwise(weights[1])


def mentions(docs: DataFrame, doc: str, text: str, title: str | None, terms: DataFrame) -> DataFrame:
    """doc, code, kind, weight: the names that each document mentions, strongest kind."""
    kept = drop_credit_or_lyrics(docs, text)
    found = term_matches(kept, doc, text, terms)
    if title is not None:
        found = drop_in_title(found, term_matches(kept, doc, title, terms), doc)
    each = mention_kind(found).select(doc, "code", "kind").groupBy(doc, "code").agg(F.max("kind").alias("kind"))  # 'self' sorts after 'mention'
    return each.withColumn("weight", mention_weight(F.col("kind")))


def one_vote_per_author(df: DataFrame, region: str, item: str, author: str, weight: str, kind: str) -> DataFrame:
    """region, item, mentions, authors, self_mentions: an author counts once with the strongest mention."""
    best = df.groupBy(region, item, author).agg(F.max(weight).alias("w"), F.max((F.col(kind) == "self").cast("int")).alias("s"))
    return best.groupBy(region, item).agg(F.sum("w").alias("mentions"), F.count("*").alias("authors"), F.sum("s").alias("self_mentions"))


def mention_coverage(docs: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """One row: documents, those with a mention, mentions by kind, names covered."""
    told = found.agg(F.countDistinct(doc).alias("with_mention"), F.count_if(F.col("kind") == "self").alias("self_mentions"), F.count_if(F.col("kind") == "mention").alias("plain_mentions"), F.countDistinct("code").alias("codes"))
    return docs.agg(F.count("*").alias("documents")).crossJoin(told)
