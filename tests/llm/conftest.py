import pytest

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 5), (4, "the cat", "en", "a", 7), (4, "the cat", "en", "a", 7), (None, "no id here", "en", "b", 10),
    (5, "The The THE cat sat on the mat " * 3000, "en", "b", 93000), (6, "naïve café — 東京 \U0001f600 ok", "fr", "c", 20), (7, "x", "en", "a", 1), (8, "12345 67890", "en", "a", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [(*r, i, "keep", 1.5) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, word string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
