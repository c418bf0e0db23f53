import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) tuples."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, *["s", "en"][len(row) - 2 :])[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def all_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
