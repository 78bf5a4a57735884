import pytest

#: doc_id, text, lang, source: nulls, empty and long texts, ties, repeated rows, odd white space, and a clashing column.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t  ", "en", "b"),
    (5, "don't stop; it's 3.14 ###!! <|endoftext|> été naïve Straße", "fr", "a"),
    (6, "word " * 5000, "en", "a"),
    (7, "same text here", "en", "a"),
    (8, "same text here", "en", "b"),
    (8, "same text here", "en", "b"),
    (9, "a\x1cb c  d\n\n\n e　f é \U0001f600", None, "b"),
    (None, "no id at all", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
