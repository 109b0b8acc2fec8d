import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog and runs through the wide green field until night falls over the quiet valley below"
    rows = [
        (1, base, "en", "a", 1), (2, base.upper(), "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, long, "fr", "b", 9), (6, long + " end", "fr", None, 9),
        (7, "a b c", "de", "c", 5), (8, "A b  C", "de", "c", 5), (9, "\t\n ", "de", "c", 3), (10, base + " x", "en", "a", 1), (10, base + " x", "en", "a", 1), (None, "no id here at all", "en", "a", 1),
        (12, "é" * 300, "fr", "d", 300), (13, "é" * 150 + " ö", "fr", "d", 300), (14, base, "en", "e", 1), (15, "0123456789" * 40, None, "e", 400),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

