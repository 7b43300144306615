import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark: SparkSession):
    """A function from (id, text) pairs to a documents table with extra columns whose names clash with outputs."""

    def make(rows):
        schema = DOCS + ", ids string, score string, key string, spans string, size int, kept boolean, root_key string"
        return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None, "x", None, "k", None, 1, True, "r") for i, t in rows], schema).repartition(3)

    return make
