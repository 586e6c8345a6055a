import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents with the given (doc_id, text) rows and columns whose names clash with those of the operators."""

    def make(rows):
        extra = "lang string, source string, n_chars long, n_words long, kept boolean, class string, id string, tie string, cuts string, text_key string, _t string, seed int"
        full = [(i, t, "en", "s", len(t or ""), 7, None, "c", "i", "t", "x", "k", "u", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + extra)

    return make
