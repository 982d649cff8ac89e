"""Grouped cross-validation folds that never split a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import position


def seeded_key(column: str | Column, seed: int | Column) -> Column:
    """A reproducible 60-bit shuffle key: leading hex digits of md5(seed || id)."""
    c = F.col(column) if isinstance(column, str) else column
    start = F.lit(f"{seed}|") if isinstance(seed, int) else F.concat(seed.cast("string"), F.lit("|"))
    text = F.concat(start, c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _one_stratum(df: DataFrame, group: str, stratum: str, *extra: Column) -> DataFrame:
    """One row per group; a group that spans two strata fails the job."""
    g = df.groupBy(group).agg(F.min(stratum).alias(stratum), F.max(stratum).alias("__hi"), *extra)
    checked = F.when(F.col(stratum).eqNullSafe(F.col("__hi")), F.col(stratum)).otherwise(
        F.raise_error(F.concat(F.lit("group spans strata: "), F.col(group).cast("string")))
    )
    return g.withColumn(stratum, checked).drop("__hi")


def round_robin_folds(df: DataFrame, group: str, stratum: str, n_folds: int, seed: int) -> DataFrame:
    """Deal whole groups to folds in shuffled order inside each stratum: (group, stratum, fold)."""
    groups = _one_stratum(df, group, stratum).withColumn("__key", seeded_key(group, seed))
    dealt = position(groups, [stratum], "__key", group, "__pos")
    return dealt.select(group, stratum, (F.col("__pos") % n_folds).cast("int").alias("fold"))


def latin_square_folds(
    df: DataFrame, group: str, stratum: str, label: str, n_folds: int, seed: int
) -> DataFrame:
    """Rank groups by event rate inside each stratum, shifted by a per-stratum offset.

    Every fold gets one group of every stratum and a spread of rate ranks.  Returns
    (group, stratum, rate, fold).
    """
    rate = F.avg(F.col(label).cast("double")).alias("rate")
    groups = _one_stratum(df, group, stratum, rate).withColumn("__key", seeded_key(group, seed))
    ranked = position(groups, [stratum], "rate", "__key", "__pos")
    strata = groups.select(stratum).distinct().withColumn("__skey", seeded_key(stratum, seed))
    offsets = position(strata, [], "__skey", "__skey", "__off").select(stratum, "__off")
    return ranked.join(offsets, stratum).select(
        group, stratum, "rate", ((F.col("__pos") + F.col("__off")) % n_folds).cast("int").alias("fold")
    )


def attach_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Every row's held-out fold; train and test of fold k are ``fold <> k`` and ``fold = k``."""
    return df.join(folds.select(group, "fold"), group)


def leakage(assigned: DataFrame, unit: str, fold: str = "fold") -> DataFrame:
    """Units whose rows sit in more than one fold; must be empty for every unit column."""
    return (
        assigned.groupBy(unit)
        .agg(F.min(fold).alias("low_fold"), F.max(fold).alias("high_fold"))
        .where("low_fold <> high_fold")
    )


def fold_spec(folds: DataFrame, task: str, group: str, n_folds: int, seed: int) -> dict:
    """Small JSON-ready record of the group-to-fold map (one entry per group)."""
    return {
        "task": task,
        "group_col": group,
        "n_folds": n_folds,
        "seed": seed,
        "group_fold": {str(r[group]): r["fold"] for r in folds.select(group, "fold").toLocalIterator()},
    }
