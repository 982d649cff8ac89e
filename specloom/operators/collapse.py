"""Collapsing repeat views to one vector per unit, block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vector(column: str, size: int) -> Column:
    """Element-wise mean of equal-length arrays.

    One average per position keeps the partial aggregate a single row per key with
    ``size`` sums; exploding would instead make ``size`` rows per view.
    """
    return F.array(*[F.avg(F.get(F.col(column), F.lit(i)).cast("double")) for i in range(size)])


def mean_vector_skipnan(column: str, size: int) -> Column:
    """Element-wise mean over finite entries; a position with none is NaN."""

    def one(i: int) -> Column:
        x = F.get(F.col(column), F.lit(i)).cast("double")
        return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))

    return F.array(*[one(i) for i in range(size)])


def side_averaged(
    views: DataFrame, unit: str, cells: Sequence[str], vector: str, size: int, wanted_cells: int
) -> DataFrame:
    """Mean vector per (unit, cell), keeping only units seen in every cell.

    ``one_sided`` marks cells built from a single view.
    """
    blocks = views.groupBy(unit, *cells).agg(
        mean_vector(vector, size).alias(vector), F.count(F.lit(1)).alias("views")
    )
    complete = blocks.groupBy(unit).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") == wanted_cells)
    return blocks.join(complete.select(unit), unit, "left_semi").withColumn("one_sided", F.col("views") < 2)


def dropped_units(views: DataFrame, unit: str, cells: Sequence[str], wanted_cells: int) -> DataFrame:
    """Units missing at least one cell."""
    seen = views.select(unit, *cells).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("cells"))
    return seen.where(F.col("cells") < wanted_cells)


def stack_blocks(blocks: DataFrame, unit: str, cell: str, vector: str, order: Sequence[str]) -> DataFrame:
    """Concatenate one vector per cell in the given cell order, one row per unit."""
    picks = [F.first(F.when(F.col(cell) == c, F.col(vector)), ignorenulls=True) for c in order]
    return blocks.groupBy(unit).agg(F.concat(*picks).alias(vector))


def delta_block(blocks: DataFrame, unit: str, cell: str, vector: str, early: str, late: str) -> DataFrame:
    """Late minus early vector per unit, for units that have both."""
    pick = lambda c: F.first(F.when(F.col(cell) == c, F.col(vector)), ignorenulls=True)
    both = blocks.groupBy(unit).agg(pick(early).alias("a"), pick(late).alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL"
    )
    return both.select(unit, F.zip_with("b", "a", lambda x, y: x - y).alias(vector))
