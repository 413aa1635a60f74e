import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls in any column, an empty text, a very long one, ties and repeated rows, and columns that clash with results' names.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a row without an id but with some words in its text for once", "en", None, 5),
    (None, None, None, "b", None),
    (4, "  \t\n\x0b\x0c\r ", "fr", "b", 7),
    (5, "Ünïcödé ﬁne 漢字 \U0001f600 é́   x", "fr", "b", 9),
    (6, LONG, "en", "a", len(LONG)),
    (7, "one", "en", "c", 3),
    (8, "the quick brown fox jumps over the lazy dog and runs far away", "en", "b", 10),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, fp int, row string, kept string, media string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "s", 1, "r", "k", "m") for r in ROWS], NAMES)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
