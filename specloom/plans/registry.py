"""Registry of named queries: a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Reads the shared parquet tables lazily, one scan per mention."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def r6(col: Column | str) -> Column:
    """Round to 6 places without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])
