import pytest


@pytest.fixture
def docs(spark):
    """Makes a table of (doc_id, text), with columns whose names clash with those that operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, size int")

    return make
