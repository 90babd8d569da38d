import pandas as pd
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty, long and repeated texts, repeated rows, and columns that clash."""
    long = "word " * 30_000 + "x" * 5_000
    rows = [
        (1, "one two three four five six", "a", 1),
        (1, "one two three four five six", "a", 1),
        (2, "", "b", None),
        (3, None, None, 3),
        (None, "null id with some words in it", "c", 4),
        (5, "   \n\t ", None, 5),
        (6, long, "d", 6),
        (7, "One two THREE four five six", "e", 7),
        (2**62, "é ß 日本 🙂 \n\n x", "f", 8),
        (-4, "don't stop", "g", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, DOC_ID string, score int")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
