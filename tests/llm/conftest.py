import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, id int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards box with one another near the river bank"
    rows = [
        (1, prose, "en", "a.example.com", 1, "x", 9),
        (2, prose + " today", "en", "a.example.com", 1, "x", 9),
        (3, None, None, None, None, None, None),
        (4, "", "de", "b.example.de", 0, "x", 9),
        (5, " \n\t ", "fr", None, 4, "x", 9),
        (6, "word " * 40_000, "en", "a.example.com", 1, "x", 9),
        (7, "eins", "de", "b.example.de", 4, "x", 9),
        (7, "eins", "de", "b.example.de", 4, "x", 9),
        (None, prose, "en", "a.example.com", 1, "x", 9),
        (8, "a  b \n c ▁ naïve 日本語 \U0001f600  ", "en", "c", 1, "x", 9),
        (9, "der die das und nicht eine kleine straße führt über den fluss in die alte stadt", "de", "b.example.de", 1, "x", 9),
        (10, "der die das und nicht eine kleine straße führt über den fluss in die alte stadt", None, "b.example.de", 1, "x", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
