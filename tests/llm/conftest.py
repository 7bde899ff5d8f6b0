import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents from (id, text) pairs."""
    def make(rows, extra=""):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, WIDE)
    return make
