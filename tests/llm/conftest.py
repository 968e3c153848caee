import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, `_items` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated
    rows, and extra columns whose names the operators use themselves."""
    long_text = "Lorem wird " * 40_000 + "\n" + "x" * 50_000
    rows = [
        (1, "The same line of text that is long enough to be counted as one line\nown", "en", "a", 10, "d", 1, "i"),
        (2, "The same line of text that is long enough to be counted as one line\nown", "en", "a", 10, "d", 1, "i"),
        (2, "The same line of text that is long enough to be counted as one line\nown", "en", "a", 10, "d", 1, "i"),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "b", 0, None, None, None),
        (None, "words without an id", "en", None, 19, "d", 2, "i"),
        (5, long_text, "de", "b", len(long_text), "d", 3, "i"),
        (6, "... 123 !!!", "en", "b", 11, "d", 3, "i"),
        (7, "été \U0001f600 \x1c odd <|endoftext|> \x00 text", "fr", "c", 30, "d", 3, "i"),
        (-8, "  a  b\n\n\t c ", "en", "c", 12, "d", 3, "i"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
