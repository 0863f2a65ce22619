import pytest


@pytest.fixture
def docs(spark):
    """Documents frame from (doc_id, text) pairs, with columns whose names operators also use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, score double")

    return make
