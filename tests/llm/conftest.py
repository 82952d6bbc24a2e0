import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars int, size int, h string, row long, " \
      "shard int, copies int, score double, words string, b long, digest string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (doc_id, text, lang, source) with extra columns whose names clash."""
    def make(rows):
        return spark.createDataFrame([(*r, 1, 7, "h", 3, 99, 5, 0.5, "w", 1, "d") for r in rows], DOC)
    return make


EN = "the cat sat on the mat and looked at the old dog near the warm fire in the small house "
DE = "der hund und die katze sitzen vor dem alten haus und warten auf das kleine kind "
ODD = [
    (1, EN, "en", "a"), (2, DE, "de", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "a"),
    (6, "12 34 !!", "en", "b"), (None, EN + "x", "en", None), (None, None, None, None),
    (8, EN * 2500, "en", "a"), (9, "a" * 120_000, "de", "b"), (10, "7" * 60_000, "en", "a"),
    (11, DE, "de", "b"), (11, DE, "de", "b"), (11, DE, "de", "b"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
