"""The end-to-end evaluation: views to blocks, representations, nested folds, controls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import spectrum_pipeline
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import nested as NE
from ..operators.collapse import side_averaged
from ..session import settle


def unit_blocks(views: DataFrame, unit: str, vector: str, size: int, cells: Sequence[tuple]) -> DataFrame:
    """One row per unit with one averaged vector per (mode, hours) cell: ``block_0``, ``block_1``, ..."""
    blocks = side_averaged(views, unit, ["mode", "hours"], vector, size, len(cells))
    pick = lambda c: F.first(
        F.when((F.col("mode") == c[0]) & (F.col("hours") == c[1]), F.col(vector)), ignorenulls=True
    )
    return blocks.groupBy(unit).agg(*[pick(c).alias(f"block_{i}") for i, c in enumerate(cells)])


def representations(
    blocks: DataFrame, unit: str, cells: Sequence[tuple], size: int, sets: dict[str, list[tuple]], derivs: Sequence[int]
) -> tuple[DataFrame, dict[str, list[tuple[int, int]]]]:
    """One vector ``x`` of every block under every derivative, and each representation's ranges of it.

    Each block is preprocessed on its own and a representation is several blocks side by
    side, because a normalisation across two modes would mix their scales.
    """
    steps = [(c, d) for c in cells for d in derivs]
    x = F.concat(*[spectrum_pipeline(f"block_{cells.index(c)}", d) for c, d in steps]).alias("x")
    at = {step: (k * size, (k + 1) * size) for k, step in enumerate(steps)}
    parts = {f"{name}_d{d}": [at[m, d] for m in members] for name, members in sets.items() for d in derivs}
    return blocks.select(unit, x), parts


def controls(oof: DataFrame, group: str, stratum: str, ident: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scope, metric, value): pooled, within-group, within-stratum and per-stratum results."""
    s = M.binary_summary(oof, "y", "score", ident, 0.5, pred="pred", keys=keys)
    keep = ["auc", "ap_positive", "ap_never", "balanced_accuracy", "sensitivity", "specificity", "prevalence"]
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in keep])
    parts = [s.select(*keys, F.lit("pooled").alias("scope"), F.inline(pairs))]
    one = lambda df, scope, value: df.select(*keys, scope.alias("scope"), F.lit("auc").alias("metric"), F.col(value).alias("value"))
    for scope, column in (("within_group", group), ("within_stratum", stratum)):
        parts.append(one(M.within_group_auc(oof, "y", "score", column, keys), F.lit(scope), "within_auc"))
    per = M.auc(oof, "y", "score", [*keys, stratum])
    parts.append(one(per, F.concat(F.lit("stratum_"), F.col(stratum).cast("string")), "auc"))
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(
    rows: DataFrame, ident: str, group: str, stratum: str, label: str, parts: dict[str, list[tuple[int, int]]],
    n_folds: int = 5, repeats: int = 1, grid: Sequence[int] = ML.GRID_BINARY, permutations: int = 0, seed: int = 20260817,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold rows and choices of every repeat with the true labels (set 0) and, on the first
    repeat, of every permuted label set, all in one plan."""
    rows = settle(rows)
    fold = settle(NE.repeated_folds(rows, group, stratum, label, n_folds, repeats, seed))
    truth = rows.withColumn("ys", F.array(F.col(label).cast("int")))
    data = settle(ML.label_sets(rows, ident, group, label, permutations, seed)) if permutations else truth
    runs = [(r, 0) for r in range(repeats)] + [(0, s) for s in range(1, permutations + 1)]
    return NE.nested_runs(data, ident, group, stratum, parts, fold, runs, n_folds, ML.INNER_FOLDS, grid, seed)


def evaluate(
    rows: DataFrame, ident: str, group: str, stratum: str, label: str, parts: dict[str, list[tuple[int, int]]],
    n_folds: int = 5, repeats: int = 1, grid: Sequence[int] = ML.GRID_BINARY, permutations: int = 0, seed: int = 20260817,
) -> DataFrame:
    """Repeated nested CV with controls: (repeat, label_set, scope, metric, value).

    Every repeat re-deals whole groups to folds.  Label set 0 is the truth; the others
    are permutation floors, run on the first repeat.
    """
    oof, _ = out_of_fold(rows, ident, group, stratum, label, parts, n_folds, repeats, grid, permutations, seed)
    oof = settle(oof)
    strata = rows.groupBy(group).agg(F.min(stratum).alias(stratum))
    told = controls(settle(oof.where("set = 0").join(strata, group)), group, stratum, ident, ["repeat"])
    out = told.select("repeat", F.lit(0).alias("label_set"), "scope", "metric", "value")
    if permutations:
        floor = M.auc(oof.where("set > 0"), "y", "score", ["repeat", "set"])
        out = out.unionByName(floor.select(
            "repeat", F.col("set").alias("label_set"), F.lit("permuted").alias("scope"), F.lit("auc").alias("metric"), F.col("auc").alias("value")
        ))
    return out
