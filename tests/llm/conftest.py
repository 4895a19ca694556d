import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
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
    def make(texts, ids=None, **more):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        for name, value in more.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.select("doc_id", "text").collect()}
