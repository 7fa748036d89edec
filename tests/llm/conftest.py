import pytest


@pytest.fixture
def docs_of(spark):
    """Rows (doc_id, text) as a table with columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(i, t, "en", 1, 2, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, line int, cls string")

    return make
