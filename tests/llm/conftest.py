import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], SCHEMA)

    return make
