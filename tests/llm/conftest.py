import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, a clashing column."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog while seven wizards quietly box a kangaroo near the old mill"
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (None, base, None, None, None), (None, None, None, None, None),
            (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \t\n ", None, "b", 3), (6, long, "en", None, len(long)),
            (7, base + " again", "en", "a", 2), (8, "one", "en", "a", 3), (8, "one", "en", "a", 3), (9, "\n\n\n", "en", "a", 3), (10, "é ß 漢字 \U0001f600", "xx", "c", 9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df, column="text"):
    return sorted(((r.doc_id, r[column]) for r in df.collect()), key=repr)
