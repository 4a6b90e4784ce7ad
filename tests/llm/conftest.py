import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, text_b string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = "palabra " * 3000
    rows = [(1, None), (2, ""), (3, "x"), (4, " \n\t\n"), (5, long), (6, long), (7, "One two three four five six."), (7, "One two three four five six."), (None, "lost words here and there"), (8, "é🙂\u0000 z\u0001"), (9, "a" * 5000)]
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", None, "own", "x") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
