import pytest

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and columns named like the operators' own."""
    rows = [
        (1, None, None, "x", 1), (2, "", "en", None, 2), (None, "a text without an id, but long enough for a line of its own", "en", "s", None), (3, LONG, "en", "s", len(LONG)), (4, "same text\nsame text", "en", "s", 3), (4, "same text\nsame text", "en", "s", 3),
        (5, "same text\nsame text", "de", "s", 3), (6, "   \n\t ", "en", "s", 4), (7, "ünï ▁ 日本 \U0001f600 é", "fr", "s", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("toxicity", "n_links", "gone", "ids", "s", "t", "base", "pii", "fp", "component_id", "text_key", "page_id", "class", "shingle"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
