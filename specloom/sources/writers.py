"""Sinks.  Spark's committer makes every write all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null


def scrub(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every double, float and array of them."""
    def clean(field):
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            return finite_or_null(field.name).alias(field.name)
        if kind in ("array<double>", "array<float>"):
            return F.transform(field.name, lambda x: finite_or_null(x)).alias(field.name)
        return F.col(field.name)

    return df.select(*[clean(f) for f in df.schema])


def json_text(df: DataFrame) -> DataFrame:
    """Rows as JSON text in which NaN and infinities stay readable, as the words for them."""
    def words(x):
        return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(x.cast("string"))

    def shown(field):
        kind, col = field.dataType.simpleString(), F.col(field.name)
        finite = ~F.isnan(col) & (F.abs(col) != float("inf"))
        if kind in ("double", "float"):
            return F.when(finite, F.to_json(F.struct(col.alias(field.name)))).otherwise(F.to_json(F.struct(words(col).alias(field.name))))
        if kind in ("array<double>", "array<float>"):
            return F.to_json(F.struct(F.transform(field.name, words).alias(field.name)))
        return F.to_json(F.struct(col))

    inner = [F.regexp_replace(shown(f), r"^\{|\}$", "") for f in df.schema]
    return df.select(F.concat(F.lit("{"), F.array_join(F.filter(F.array(*inner), lambda x: x != ""), ","), F.lit("}")).alias("value"))


def write_views(views: DataFrame, path: str) -> None:
    """The view table, partitioned the way selections prune it."""
    views.repartition("mode", "hours").write.mode("overwrite").partitionBy("mode", "hours").parquet(path)


def write_cube(cube: DataFrame, path: str) -> None:
    """A cube table, one folder per capture."""
    cube.write.mode("overwrite").partitionBy("capture").parquet(path)


def archive_lines(lines: DataFrame, path: str) -> None:
    """Raw line contents with their order, kept as a table."""
    lines.select("capture", "line", "name", F.length("content").alias("size"), "content").write.mode("overwrite").partitionBy(
        "capture"
    ).parquet(path)


def write_run(predictions: DataFrame, meta: DataFrame, path: str) -> None:
    """A run: predictions as Parquet, its small record as scrubbed JSON."""
    scrub(predictions).write.mode("overwrite").parquet(f"{path}/predictions")
    scrub(meta).repartition(1).write.mode("overwrite").json(f"{path}/meta")


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report table (groups x statistics) as one CSV file."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
