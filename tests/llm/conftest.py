import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _position string, n long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, further columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "x", "en", None, 1), (4, long, "de", "b", len(long)),
        (5, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (6, "alpha beta gamma delta epsilon zeta", "fr", "b", 35),
        (6, "alpha beta gamma delta epsilon zeta", "fr", "b", 35), (None, "no id here at all my friend", "en", "a", 27),
        (None, None, None, None, None), (7, "   \n\t ", "en", "c", 6), (8, "!!! ???", "en", "c", 7), (9, "é😀x", "fr", "c", 3),
    ]
    return [(*r, 0.25, "mine", 3) for r in rows]


@pytest.fixture
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Makes seeded prose from a small vocabulary."""

    def make(seed, words=60, vocabulary=400):
        draw = random.Random(seed)
        return " ".join(f"word{draw.randrange(vocabulary)}" for _ in range(words))

    return make
