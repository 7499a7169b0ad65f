import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in all columns, an empty and a long text, repeated rows, and columns whose names clash with results."""
    long = "lorem ipsum dolor " * 4000
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en"), (1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, "en"), (None, "a text without an id", None), (3, "", "fr"), (4, long, "de"), (5, "the quick brown fox jumps over the lazy dog", None), (6, "   \n\t\n ", "en")]
    return spark.createDataFrame([(*r, 7, True, "x", 0.5) for r in rows], "doc_id bigint, text string, lang string, n_tokens int, keep boolean, source string, score double")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
