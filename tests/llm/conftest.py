import pytest

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "word",
    "two words",
    "Ünïcödé wörds and one nbsp",
    "the same text here " * 40,
    "the same text here " * 40,
    "a " * 3000 + "end",
    " ".join(f"w{i}" for i in range(5000)),
    " ".join(f"w{i}" for i in range(5000)),
    " ".join(f"w{i}" for i in range(100, 160)),
    "x" * 20000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null ids, repeated rows, odd texts and columns whose names operators use inside."""
    rows = [(i, t, ["en", None][i % 2], [None, "s", "t"][i % 3], 1, 2, 3, "z", 4.0) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[6], (None, "no id at all, but words", "en", "s", 1, 2, 3, "z", 4.0), (None, None, None, None, 1, 2, 3, "z", 4.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, uid int, id int, n int, shard string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
