import pytest

LONG = " ".join(f"word{i % 700}" for i in range(9000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names clash."""
    rows = [
        (1, None, "a", 5), (2, "", "b", None), (3, LONG, None, 1), (4, "one", "c", 2), (4, "one", "c", 2), (None, "some text with a few words in it", "d", 3),
        (5, "a b c a b c a b c", "e", 1), (6, "é 😀 naïve ​  x\ty\r\nz", "f", 1), (7, "don't I'll we've 123 ½ ²", "g", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
