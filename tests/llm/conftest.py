import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def by_id():
    """Rows of a result keyed by doc_id, as dicts."""
    return lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
