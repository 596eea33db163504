import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null columns, empty and blank texts, repeated rows, ties, one long text, and a clashing column.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again"),
    (2, "the quick brown\tfox jumps over\nthe lazy dog again "),
    (3, "The quick brown fox jumps over the lazy dog again"),
    (3, "The quick brown fox jumps over the lazy dog again"),
    (4, None),
    (5, ""),
    (6, " \t\r\n\x0b\x0c"),
    (None, "no id here at all"),
    (8, "two words"),
    (9, "two  words"),
    (10, "Été à la plage avec <|endoftext|> l'été, naïve co-op №5 'tis"),
    (11, "x" * 9000 + "y"),
    (12, "x" * 9000 + "z"),
    (13, "word " * 5000),
    (14, "ab" * 20000),
    (15, "ab" * 20000 + " "),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None if i == 5 else "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS kept", "1 AS row", "2L AS fp", "'q' AS sha", "7 AS name", "8 AS length").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
