import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of texts; ids count from 0, unless pairs are given."""

    def frame(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return frame


@pytest.fixture(scope="session")
def sample(spark):
    """Real documents with their extra columns."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
