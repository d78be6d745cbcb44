import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with a column that clashes with internal names."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, _id string").repartition(3)
    return make
