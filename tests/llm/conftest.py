"""Small tables with awkward rows."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty texts, one very long text, repeated rows."""
    long = " ".join(f"word{k % 997} is{k}" for k in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, long, "en", "b", len(long)), (5, "\n\n \t\n", "fr", "a", 5), (None, "no id", "en", "a", 5), (6, "日本 é́ 🙂 ﷺ \x00 z", "xx", "c", 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
