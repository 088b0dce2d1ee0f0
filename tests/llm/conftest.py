import pytest


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, source=None):
        full = [(d, t, "en", source[i] if source else "s", i, "x", -1) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int").repartition(3)

    return make
