"""Small document tables with the awkward rows every operator must take."""

import pytest

PASSAGE = " ".join(f"shared{i}" for i in range(60))
WORDS = [f"w{i}" for i in range(400)]


def text(seed, n=80):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(0, text(0)), (1, None), (2, ""), (3, "  \n \t"), (4, text(4)), (4, text(4)), (None, text(5)),
            (None, None), (6, long), (7, text(0)), (8, text(8) + "\n" + PASSAGE), (9, PASSAGE + "\n" + text(9)),
            (10, "one"), (11, "one")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7, "x", "k") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "score double, id long, key string, h string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
