"""Sampling operators whose limit is the point, and flip augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import seeded_key
from .ordered import position
from .select import first_per


def sample_per_group(df: DataFrame, keys: Sequence[str], ident: str, size: int, seed: int) -> DataFrame:
    """``size`` rows per group without replacement, the same for a given seed."""
    shuffled = position(df.withColumn("__key", seeded_key(ident, seed)), keys, "__key", ident, "__pos")
    return shuffled.where(F.col("__pos") < size).drop("__key", "__pos")


def systematic_sample(df: DataFrame, row: str, about: int) -> DataFrame:
    """Every k-th row id, k chosen so that about ``about`` rows remain."""
    step = df.agg(F.greatest(F.floor(F.count(F.lit(1)) / about), F.lit(1))).scalar()
    return df.withColumn("__step", step).where(F.col(row) % F.col("__step") == 0).drop("__step")


def first_example(df: DataFrame, label: str, order: str, carry: Sequence[str]) -> DataFrame:
    return first_per(df, [label], order, carry)


def flip_augment(pixels: DataFrame, view: str, height: int, width: int, seed: int, p: float = 0.5) -> DataFrame:
    """Mirror whole patches up-down and left-right, each with probability p by view."""
    coin = lambda axis: seeded_key(F.concat(F.lit(axis), F.col(view).cast("string")), seed) < int(p * 16**15)
    return pixels.withColumn("py", F.when(coin("y"), height - 1 - F.col("py")).otherwise(F.col("py"))).withColumn(
        "px", F.when(coin("x"), width - 1 - F.col("px")).otherwise(F.col("px"))
    )
