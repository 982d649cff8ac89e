"""Report tables: the numbers behind summaries, as small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .ordered import exact_percentiles, null_safe_join


def dataset_overview(views: DataFrame, unit: str, keys: Sequence[str], measure: str) -> DataFrame:
    """Views, units and the median of one measure per selector combination."""
    counts = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("views"), F.count_distinct(unit).alias("units"))
    med = exact_percentiles(views, keys, measure, {"median": 0.5}).drop("n")
    return null_safe_join(counts, med, keys, "left")


def fold_table(oof: DataFrame, truth: str, pred: str, classes: int, fold: str = "fold") -> DataFrame:
    """Metrics of every outer fold."""
    return M.classification_summary(oof, truth, pred, classes, [fold])


def per_class_recall(oof: DataFrame, truth: str, pred: str, classes: int) -> DataFrame:
    c = M.class_counts(oof, truth, pred, classes)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return c.select(
        "cls", (F.col("tp") + F.col("fn")).alias("support"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(tp, tp + fp).alias("precision")
    )


def mask_review(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per capture: masks, the smallest containment, and the pixels lost to cleaning."""
    return masks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("masks"), F.min("containment").alias("min_containment"),
        F.sum("dropped_px").alias("dropped_px"), F.count_if(F.col("n_components_raw") > 1).alias("with_specks"),
    )


def grid_summary(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat summary of plate fits, lists joined to text, ready for CSV."""
    text = lambda c: F.array_join(c, "; ").alias(c)
    keep = [c for c in ("pose", "margin", "rms", "n_matched", "n_duplicate", "pitch_x", "pitch_y", "status") if c in fits.columns]
    return fits.select(*keys, *keep, *[text(c) for c in ("reasons", "flags", "info")])
