"""Grouped, nested cross-validation of PLS discriminants on distributed rows.

The rows are read once to build one cross-product matrix per group of the fold
structure; every training set of every fold is a sum of those matrices.  Fitting then
works on bands x bands numbers, and scoring is a dot product against a coefficient
table of at most folds x component counts x bands entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pls import pls_path
from ..functions.spectral import dot
from ..session import settle, written
from . import metrics as M
from .folds import seeded_key
from .nested import nested_runs
from .ordered import position

# Component grids, inner folds, permutation repeats and the feature sets by name.
GRID_CLASSES = tuple(range(2, 25, 2))
GRID_BINARY = tuple(range(2, 21, 2))
INNER_FOLDS, PERMUTATIONS = 4, 10
FEATURE_SETS = {
    "refl_0h": [("reflectance", 0.0)],
    "refl_8h": [("reflectance", 8.0)],
    "trans_0h": [("transmittance", 0.0)],
    "trans_8h": [("transmittance", 8.0)],
    "refl_both": [("reflectance", 0.0), ("reflectance", 8.0)],
    "trans_both": [("transmittance", 0.0), ("transmittance", 8.0)],
    "all": [("reflectance", 0.0), ("reflectance", 8.0), ("transmittance", 0.0), ("transmittance", 8.0)],
}


def group_grams(df: DataFrame, group: str, x: str, y: str, p: int, k: int) -> DataFrame:
    """Z'Z per group for Z = [x, y, 1], one row per matrix row: (group, i, v).

    Each task sums its own rows, so the shuffle carries tasks x groups matrices and
    the final sums are ordinary aggregates.  ``group`` must be a bounded set such as
    dishes or folds.
    """
    size = p + k + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()), np.ones(len(pdf))])
            keys = pdf["g"].to_numpy()
            for g in pd.unique(keys):
                rows = z[keys == g].astype(float)
                sums[g] = sums.get(g, 0.0) + rows.T @ rows
        for g, m in sums.items():
            yield pd.DataFrame({"g": [g] * size, "i": np.arange(size), "v": list(m)})

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(
        F.col(group).alias("g"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")
    )
    parts = rows.mapInPandas(partial, f"g {kind}, i int, v array<double>")
    summed = F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(size)])
    return parts.groupBy(F.col("g").alias(group), "i").agg(summed.alias("v"))


def _sum_grams(grams: DataFrame, members: DataFrame, group: str, keys: Sequence[str], size: int) -> DataFrame:
    """Gram rows of every training set: the sum over its member groups."""
    joined = grams.join(members.select(*keys, group), group)
    return joined.groupBy(*keys, "i").agg(
        F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(size)]).alias("v")
    )


def fit_paths(train: DataFrame, keys: Sequence[str], p: int, grid: Sequence[int], columns: str) -> DataFrame:
    """PLS path of every training set: (keys, n, b, b0) with one score vector per class.

    ``train`` rows are (keys, i, v, columns); ``columns`` names the label columns of the
    set's own task, as positions among the y block.  One group is one matrix.
    """
    kinds = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        g = np.stack(pdf["v"].to_numpy())
        use = [*range(p), *[p + int(c) for c in pdf[columns].iloc[0]], len(g) - 1]
        paths = pls_path(g[np.ix_(use, use)], p, list(grid))
        head = {k: pdf[k].iloc[0] for k in keys}
        rows = [{**head, "n": n, "b": [list(col) for col in b.T], "b0": list(b0)} for n, (b, b0) in paths.items()]
        return pd.DataFrame(rows, columns=[*keys, "n", "b", "b0"])

    return train.groupBy(*keys).applyInPandas(
        fit, f"{kinds}, n int, b array<array<double>>, b0 array<double>"
    )


def linear_scores(x: Column, b: Column, b0: Column) -> Column:
    """One score per class."""
    return F.zip_with(F.transform(b, lambda w: dot(x, w)), b0, lambda s, c: s + c)


def other_folds(folds: DataFrame, group: str) -> DataFrame:
    """(group, outer) for every outer fold the group trains in."""
    every = folds.agg(F.array_sort(F.collect_set("fold"))).scalar()
    return folds.withColumn("__all", every).select(
        group, F.explode(F.array_except("__all", F.array("fold"))).alias("outer")
    )


def label_sets(df: DataFrame, ident: str, group: str, label: str, repeats: int, seed: int) -> DataFrame:
    """Adds ``ys``: the true 0/1 label followed by ``repeats`` permuted ones.

    In a permuted set every group draws its labels with replacement from one donor
    group.  A draw is a hashed index into the donor's label-sorted members, so only the
    donor's (positives, size) has to reach the rows.
    """
    counts = df.groupBy(group).agg(F.sum(label).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    sets = counts.select(group, "__pos", "__n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__rep"))
    taker = sets.withColumn("__a", seeded_key(F.concat(F.col("__rep").cast("string"), F.lit("t"), F.col(group).cast("string")), seed))
    giver = sets.withColumn("__b", seeded_key(F.concat(F.col("__rep").cast("string"), F.lit("g"), F.col(group).cast("string")), seed))
    t = position(taker, ["__rep"], "__a", group, "__k").select(group, "__rep", "__k")
    g = position(giver, ["__rep"], "__b", group, "__k").select("__rep", "__k", F.col("__pos").alias("dpos"), F.col("__n").alias("dn"))
    donor = t.join(g, ["__rep", "__k"]).groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("__rep", "dpos", "dn"))).alias("__donors")
    )
    draw = lambda d: F.pmod(
        seeded_key(F.concat(F.lit("draw"), d["__rep"].cast("string"), F.lit("|"), F.col(ident).cast("string")), seed), d["dn"]
    )
    shuffled = F.transform("__donors", lambda d: (draw(d) < d["dpos"]).cast("int"))
    return df.join(donor, group).withColumn("ys", F.concat(F.array(F.col(label).cast("int")), shuffled)).drop("__donors")


def nested_cv(
    rows: DataFrame,
    ident: str,
    group: str,
    stratum: str,
    vectors: dict[str, tuple[str, int]],
    folds: DataFrame,
    n_inner: int = INNER_FOLDS,
    grid: Sequence[int] = GRID_BINARY,
    n_sets: int = 1,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Nested grouped CV of a binary discriminant; returns (out-of-fold rows, choices).

    ``rows`` carries ``ys`` (one 0/1 label per label set) and one vector column per
    entry of ``vectors`` = {name: (column, length)}; ``folds`` maps group to outer fold.
    See ``nested.nested_runs``, of which this is one repeat with every label set.
    """
    parts, start = {}, 0
    for name, (_, p) in vectors.items():
        parts[name] = [(start, start + p)]
        start += p
    # read by every scan behind: labels, matrices, scores
    wide = written(rows.select(ident, group, stratum, "ys", F.concat(*[F.col(c).cast("array<double>") for c, _ in vectors.values()]).alias("x")), "rows")
    n_folds = (folds.agg(F.max("fold")).first()[0] or 0) + 1
    oof, choices = nested_runs(
        wide, ident, group, stratum, parts, folds.select(F.lit(0).alias("repeat"), group, "fold"),
        [(0, s) for s in range(n_sets)], n_folds, n_inner, grid, seed,
    )
    return oof.drop("repeat"), choices.drop("repeat")


def fold_records(oof: DataFrame, choices: DataFrame) -> DataFrame:
    """One record per outer fold: what was chosen, and how it does on the fold it never saw."""
    per = M.auc(oof, "y", "score", ["set", "fold"])
    hard = M.classification_summary(oof, "y", "pred", 2, ["set", "fold"]).select("set", "fold", F.col("n").alias("rows"), "balanced_accuracy")
    said = choices.select("set", F.col("outer").alias("fold"), "rep", "n", "inner_auc", "threshold")
    return said.join(per, ["set", "fold"], "left").join(hard, ["set", "fold"], "left")


def permutation_summary(floors: DataFrame) -> DataFrame:
    """Mean and spread of the AUC of the permuted label sets (set > 0), beside the true one (set 0)."""
    return floors.agg(
        F.max(F.when(F.col("set") == 0, F.col("auc"))).alias("auc"),
        F.avg(F.when(F.col("set") > 0, F.col("auc"))).alias("floor_mean"),
        F.stddev_pop(F.when(F.col("set") > 0, F.col("auc"))).alias("floor_std"),
        F.count(F.when(F.col("set") > 0, F.col("auc"))).alias("repeats"),
    )


def plsda_cv(
    rows: DataFrame, ident: str, group: str, label: str, classes: int, vector: str, p: int, folds: DataFrame,
    grid: Sequence[int] = GRID_CLASSES, n_inner: int = INNER_FOLDS,
) -> tuple[DataFrame, DataFrame]:
    """Multi-class PLS discriminant under grouped CV; returns (out-of-fold rows, choices).

    The component count is chosen per outer fold by balanced accuracy averaged over the
    inner folds (ties: fewer components), on inner folds of whole groups.
    """
    others = other_folds(folds, group)
    dealt = settle(position(others.withColumn("__key", seeded_key(group, 0)), ["outer"], "__key", group, "__pos"))
    held = dealt.select("outer", group, (F.col("__pos") % n_inner).cast("int").alias("held"))
    train = held.select(
        "outer", group,
        F.explode(F.filter(F.sequence(F.lit(-1), F.lit(n_inner - 1)), lambda i: i != F.col("held"))).alias("inner"),
    )
    test = held.select("outer", group, F.col("held").alias("inner")).unionByName(
        folds.select(F.col("fold").alias("outer"), group, F.lit(-1).alias("inner"))
    )
    hot = F.array(*[(F.col(label) == c).cast("double") for c in range(classes)])
    grams = settle(group_grams(rows.withColumn("__y", hot), group, vector, "__y", p, classes))
    sums = _sum_grams(grams, train, group, ["outer", "inner"], p + classes + 1)
    sums = sums.withColumn("cols", F.sequence(F.lit(0), F.lit(classes - 1)))
    fits = settle(fit_paths(sums, ["outer", "inner"], p, grid, "cols"))
    def calls(fits: DataFrame, where: DataFrame) -> DataFrame:
        models = fits.groupBy("outer", "inner").agg(F.collect_list(F.struct("n", "b", "b0")).alias("models"))
        per_group = where.join(models, ["outer", "inner"]).groupBy(group).agg(
            F.collect_list(F.struct("outer", "inner", "models")).alias("__tasks")
        )
        each = (
            rows.select(ident, group, F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("__x"))
            .join(per_group, group)
            .select(ident, group, "y", "__x", F.inline("__tasks"))
            .select(ident, group, "y", "__x", "outer", "inner", F.inline("models"))
        )
        return each.select(
            ident, group, "y", "outer", "inner", "n", linear_scores(F.col("__x"), F.col("b"), F.col("b0")).alias("score")
        ).withColumn("pred", (F.array_position("score", F.array_max("score")) - 1).cast("int"))

    held_out = calls(fits.where("inner >= 0"), test.where("inner >= 0")).withColumnRenamed("n", "comps")
    judged = M.balanced_accuracy(held_out, "y", "pred", classes, ["outer", "inner", "comps"])
    judged = judged.groupBy("outer", F.col("comps").alias("n")).agg(F.avg("balanced_accuracy").alias("score"))
    choices = settle(judged.groupBy("outer").agg(F.min(F.struct((-F.col("score")).alias("loss"), "n")).alias("b")).select(
        "outer", F.col("b.n").alias("n"), (-F.col("b.loss")).alias("inner_balanced_accuracy")
    ))
    won = fits.where("inner = -1").join(F.broadcast(choices.select("outer", "n")), ["outer", "n"])
    final = calls(won, test.where("inner = -1"))
    return final.select(ident, group, F.col("outer").alias("fold"), "n", "y", "pred", "score"), choices


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse-frequency weights n / (classes * count) per class."""
    counts = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("__all", whole).select(
        "cls", "n", (F.col("__all").cast("double") / (F.lit(float(classes)) * F.col("n"))).alias("weight")
    )


def shuffled_group_labels(groups: DataFrame, group: str, label: str, seed: int) -> DataFrame:
    """Deal the groups' labels out to the groups in another order: (group, label)."""
    a = position(groups.withColumn("__a", seeded_key(group, seed)), [], "__a", group, "__k").select(group, "__k")
    b = position(groups.withColumn("__b", seeded_key(group, seed + 1)), [], "__b", group, "__k").select(label, "__k")
    return a.join(b, "__k").drop("__k")
