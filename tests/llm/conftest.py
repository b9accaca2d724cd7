import pytest

#: doc_id, text, lang, source, and columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, node string, n string, label string, bucket string, `a.b` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated rows."""
    extra = ("x", "y", "z", "n", "m", "l", "b", "dot")
    rows = [
        (1, "one two three four five six seven", "en", "s1", 3, *extra),
        (1, "one two three four five six seven", "en", "s1", 3, *extra),
        (2, "One two three four five six seven", "en", "s1", None, *extra),
        (3, None, None, None, None, *[None] * 8),
        (None, None, None, None, None, *[None] * 8),
        (4, "", "en", "s2", 0, *extra),
        (None, "one two three four five six seven", "en", None, 3, *extra),
        (5, "größe \t\n ñandú \x0b 日本 " + "word " * 40_000 + "end", "de", "s2", 9, *extra),
        (6, "short", "en", "s2", 5, *extra),
        (6, "other text with the same id as the one before", "en", "s3", 5, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
