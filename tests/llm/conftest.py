import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, u string"


@pytest.fixture
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (None, None, None, None, None, "x", 1, "y"),
        (1, "", "en", "a", 0, None, None, None),
        (2, " \t\n ", "en", "a", 3, "x", 1, "y"),
        (3, "One two three four", "en", None, 18, "x", 1, "y"),
        (3, "One two three four", "en", None, 18, "x", 1, "y"),
        (4, "one TWO three  four", "en", "b", 18, "x", 1, "y"),
        (5, long, "en", "b", len(long), "x", 1, "y"),
        (5, None, "en", "b", len(long), "x", 1, "y"),
        (6, "ein", "de", "", 3, "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
