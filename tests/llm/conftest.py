import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType())])


@pytest.fixture
def docs(spark):
    """Makes documents of texts; `node` is a column whose name clashes with inner ones."""

    def make(texts, ids=None, lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x") for i, t in zip(ids, texts)], DOCS)

    return make
