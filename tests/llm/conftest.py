import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows; score and kept are extra columns with clashing names."""

    def make(rows):
        full = [(*r, "en", None if i % 3 == 0 else "s", len(r[1] or ""), "extra", "x") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make


def plain(rows):
    """Rows as sorted tuples in which null sorts first."""
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v if not isinstance(v, list) else str(v)) for v in r])
