import os

import duckdb
import pytest
from llm_cases import CLASHES, ODD
from pyspark.sql import functions as F

FOLDER = os.environ.get("SPECLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("shared tables not present")
    return FOLDER


@pytest.fixture(scope="session")
def documents(folder):
    return duckdb.sql(f"select doc_id, text, lang from '{folder}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns named like an operator's own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", F.lit(None).cast("string").alias("lang"), *[F.lit(c).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
