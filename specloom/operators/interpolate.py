"""Linear gap filling between known positions, clamped at both ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cumulate


def clamp_interpolate(spine: DataFrame, known: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Value at every spine position: exact where known, linear between, flat outside.

    Each known point and its predecessor form a segment (k-1, k]; a spine position
    belongs to the segment numbered by how many known points lie before it.  The
    segments come from running totals over known points and spine together, and meet
    the spine by an equi-join on (keys, segment number).
    """
    keys = list(keys)
    points = known.select(*keys, F.col(at).cast("double").alias("__x"), F.col(value).cast("double").alias("__v"))
    marks = points.select(*keys, "__x", F.lit(1).cast("bigint").alias("__k")).unionByName(
        spine.select(*keys, F.col(at).cast("double").alias("__x"), F.lit(0).cast("bigint").alias("__k"))
    )
    counted = cumulate(marks.groupBy(*keys, "__x").agg(F.sum("__k").alias("__k")), keys, "__x", ["__k"])
    spots = counted.select(*keys, "__x", F.col("__k_before").alias("__seg"), F.col("__k_total").alias("__all"))
    numbered = points.join(spots, [*keys, "__x"])
    ends = numbered.select(*keys, "__seg", F.col("__x").alias("__x1"), F.col("__v").alias("__v1"))
    starts = numbered.select(*keys, (F.col("__seg") + 1).alias("__seg"), F.col("__x").alias("__x0"), F.col("__v").alias("__v0"))
    segments = ends.join(starts, [*keys, "__seg"], "full_outer")
    placed = spine.withColumn("__x", F.col(at).cast("double")).join(spots.drop("__all"), [*keys, "__x"])
    out = placed.join(segments, [*keys, "__seg"], "left")
    share = F.try_divide(F.col("__x") - F.col("__x0"), F.col("__x1") - F.col("__x0"))
    blend = F.coalesce(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share, F.col("__v1"), F.col("__v0"))
    return out.withColumn(value, blend).select(*spine.columns, value)


