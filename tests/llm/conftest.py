import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """A maker of documents tables from (doc_id, text) pairs, with the other columns filled in."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def make(rows, source="a", lang="en"):
        full = [r if len(r) == 5 else (r[0], r[1], lang, source, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
