import pytest

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "one two three four five", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n\x0b\x0c\r ", "b"),
    (5, "one two three four five", "a"),
    (6, "word " * 6000, "b"),
    (7, "é́ ßſK 日本語 \U0001f600 a\x1cb \x85 c\xa0d", "b"),
    (None, "no id here, but some words", None),
    (8, "x", "a"),
    (8, "x", "a"),
    (9, "don't THE'RE 12345   67  \n\n tail  ", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, s, "clash", 1.5, "p") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, size double, _text string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
