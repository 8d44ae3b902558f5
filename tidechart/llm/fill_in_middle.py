"""Fill-in-the-middle: texts cut into prefix, middle and suffix, which change places between sentinels.

A text is a run of units: words with the white space before them, and white space that ends it. One `fullmatch` of
(unit)* keeps every repetition of its group, so the ends of the captures give the number of units and the places of
both cuts. The quantifiers are possessive: a text is matched in one pass and nothing is kept for stepping back.
Python returns three numbers a text; hashes, the parts, the sentinels and the way back are Spark expressions.

What a text becomes hangs on its id and the seed alone, so reruns agree.

Defined cases: a null text is empty; an empty text has no units and stays plain, as does one that holds a sentinel;
a null id is hashed as no digits, so all such rows fall alike; repeated rows give repeated rows; equal ids fall
alike; very long texts are matched whole, 24 bytes a unit at a time; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.llm.common import table

#: The units of the contract: white space with the word after it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
UNITS = r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
#: Texts that are transformed, and those of them in suffix-prefix-middle order, of 100.
SHARE, SPM_SHARE = 50, 80
CUTS = "n long, first long, second long"


def cuts_of(text: str, h1: int, h2: int, match) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle), in code points. match: fullmatch of (unit)*."""
    ends = match(text).ends(1)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def cuts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The cuts of each text for the hashes h1 and h2."""
    import regex

    match = regex.compile(UNITS).fullmatch
    names = [part.split()[0] for part in CUTS.split(", ")]
    for texts, h1, h2 in columns:
        found = [cuts_of(t.as_py(), a, b, match) for t, a, b in zip(texts, h1.to_pylist(), h2.to_pylist())]
        yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=names)


def hashes(id_col: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of `seed:id`, as unsigned integers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; form: plain, psm or spm."""
    prefix_mark, suffix_mark, middle_mark = (F.lit(s) for s in sentinels)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = hashes(F.col("id"), seed)
    cut = rows.withColumn("cut", F.arrow_udf(cuts, CUTS)("text", h1, h2)).select("id", "text", "cut.*")
    held = F.contains("text", prefix_mark) | F.contains("text", suffix_mark) | F.contains("text", middle_mark)
    form = F.when((F.col("text") == "") | held | (h3 % 100 >= share), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    part = lambda start, stop: F.substring("text", start + 1, stop - start)
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), F.substring("text", second + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
        .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
    )
    moved = lambda c: F.when(F.col("form") != "plain", c)
    return cut.withColumn("form", form).select("id", "n", "form", moved(F.col("first")).alias("prefix_chars"), moved(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `transformed` took, from its output and form. A text that is moved holds no sentinel."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return done.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
