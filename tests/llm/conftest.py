import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents, with columns whose names clash with those that operators make."""
    return spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("label", F.lit(1)).withColumn("node", F.lit(2)).withColumn("key", F.lit(3))


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, repeated rows, nulls in every column."""
    long = "lang wort " * 20_000
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (4, long, "de", None), (4, long, "de", None), (None, "one two three four five six", None, None), (6, "x" * 30_000, "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
