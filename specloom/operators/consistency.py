"""Cross-checks of the captures of one plate against each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cumulate_rows, null_safe_join
from .plate import wrong_poses
from .variance import zscore_within

# Fixed values.
OCCUPIED = 0.12
AGREE_MIN, AGREE_MARGIN = 0.45, 0.05
PITCH_X_SPREAD, PITCH_Y_SPREAD = 4.0, 7.0


def _pearson(a: str, b: str):
    """Correlation as an aggregate; NULL where either side has no spread."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def status_counts(captures: DataFrame, field: str = "status") -> DataFrame:
    return captures.groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def capture_exceptions(captures: DataFrame, dish: str = "dish") -> DataFrame:
    """(dish, kind, subject, low, high) for everything that must not happen.

    ``captures`` holds (dish, capture, side, status, side_observed, chirality, pitch_x,
    pitch_y).  Failed captures are listed and then left out of the spread checks.
    """
    failed = F.col("status").isin("fail", "error")
    none = F.lit(None).cast("double")
    single = captures.select(
        dish,
        F.when(failed, "failed").when(F.col("side_observed") != F.col("side"), "side_mismatch").alias("kind"),
        F.col("capture").cast("string").alias("subject"),
        none.alias("low"),
        none.alias("high"),
    ).where("kind IS NOT NULL")
    usable = captures.where(~failed)
    hands = (
        usable.groupBy(dish, "side")
        .agg(F.min("chirality").alias("lo"), F.max("chirality").alias("hi"))
        .where("lo <> hi")
        .select(dish, F.lit("handedness").alias("kind"), F.col("side").alias("subject"), none.alias("low"), none.alias("high"))
    )

    def spread(column: str, limit: float) -> DataFrame:
        got = usable.groupBy(dish).agg(F.min(column).alias("low"), F.max(column).alias("high"))
        return got.where(F.col("high") - F.col("low") > limit).select(
            dish, F.lit(f"{column}_spread").alias("kind"), F.lit(column).alias("subject"), "low", "high"
        )

    parts = [single, hands, spread("pitch_x", PITCH_X_SPREAD), spread("pitch_y", PITCH_Y_SPREAD)]
    return reduce(DataFrame.unionByName, parts)


def occupancy_table(occ: DataFrame, keys: Sequence[str], capture: str, value: str) -> DataFrame:
    """One map capture -> occupancy per well; a plate is captured a dozen times at most."""
    return occ.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(capture, value))).alias("by_capture"))


def occupancy_breaks(occ: DataFrame, keys: Sequence[str], value: str, limit: float = OCCUPIED) -> DataFrame:
    """Wells that hold a kernel in some captures and not in others."""
    got = occ.groupBy(*keys).agg(
        F.count_if(F.col(value) >= limit).alias("filled"), F.count(value).alias("seen")
    )
    return got.where("filled > 0 AND filled <> seen")


def leave_one_out_median(df: DataFrame, keys: Sequence[str], ident: str, value: str, name: str = "ref") -> DataFrame:
    """Median over the other rows of the group, for every row, without pairing rows.

    Taking one element out of a sorted list of n shifts the middle by at most one, so a
    row needs its own position and up to four middle order statistics of its group.
    Rows with a NULL value drop out; a group of one gives NULL.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = cumulate_rows(rows, keys, value, ident, ["__one"]).withColumnRenamed("__one_before", "__pos")
    n = F.col("__one_total")
    lo, hi = F.floor((n - 2) / 2), F.floor((n - 1) / 2)
    at = lambda i: F.max(F.when(F.col("__pos") == i, F.col(value)))
    mids = ranked.groupBy(*keys).agg(
        F.max("__one_total").alias("__n"),
        at(lo).alias("__a0"), at(lo + 1).alias("__a1"), at(hi).alias("__b0"), at(hi + 1).alias("__b1"),
    )
    out = null_safe_join(ranked, mids, keys)
    lo2, hi2 = F.floor((F.col("__n") - 2) / 2), F.floor((F.col("__n") - 1) / 2)
    left = F.when(F.col("__pos") > lo2, F.col("__a0")).otherwise(F.col("__a1"))
    right = F.when(F.col("__pos") > hi2, F.col("__b0")).otherwise(F.col("__b1"))
    ref = F.when(F.col("__n") >= 2, (left + right) / F.lit(2.0))
    return out.select(*df.columns, ref.alias(name))


def pose_agreement(occ: DataFrame, dish: str, capture: str, well: str, value: str) -> DataFrame:
    """Does every capture agree with its dish about which well is which?

    Each capture's z-scored occupancy profile is correlated with the median profile of
    the dish's other captures, as labelled and under the three wrong poses.  Returns
    (dish, capture, corr, best_wrong_pose, best_wrong_corr, margin, verdict).
    """
    z = zscore_within(occ, [dish, capture], value).where("z IS NOT NULL").select(dish, capture, well, "z")
    ref = leave_one_out_median(z, [dish, well], capture, "z").where("ref IS NOT NULL")

    def corr(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        got = df.groupBy(*keys).agg(_pearson("z", "ref").alias(name), F.count(F.lit(1)).alias("__k"))
        return got.select(*keys, F.when(F.col("__k") > 3, F.col(name)).alias(name))

    true = corr(ref, [dish, capture], "corr")
    moves = F.broadcast(wrong_poses(occ.sparkSession).where("other IS NOT NULL"))
    theirs = ref.select(dish, capture, F.col(well).alias("index"), "ref").join(moves, "index")
    mine = z.select(dish, capture, F.col(well).alias("other"), "z")
    wrong = corr(theirs.join(mine, [dish, capture, "other"]), [dish, capture, "pose"], "wrong")
    order = F.when(F.col("pose") == "flip_col", 0).when(F.col("pose") == "flip_row", 1).otherwise(2)
    best = wrong.where("wrong IS NOT NULL").groupBy(dish, capture).agg(
        F.min(F.struct((-F.col("wrong")).alias("loss"), order.alias("o"), "pose")).alias("b")
    )
    out = true.join(best, [dish, capture], "left").select(
        dish, capture, "corr", F.col("b.pose").alias("best_wrong_pose"), (-F.col("b.loss")).alias("best_wrong_corr")
    )
    margin = F.col("corr") - F.col("best_wrong_corr")
    verdict = (
        F.when(F.col("corr").isNull() | (F.col("corr") < AGREE_MIN), "not_tracking")
        .when(margin < 0, "wrong_pose_fits_better")
        .when(margin < AGREE_MARGIN, "weak")
        .otherwise("ok")
    )
    return out.withColumn("margin", margin).withColumn("verdict", verdict)


def null_safe_corr(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson correlation over rows where both are finite; NULL up to three of them or without spread."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    got = df.where(ok(a) & ok(b)).groupBy(*keys).agg(_pearson(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("corr", F.when(F.col("n") > 3, F.col("corr")))


def merge_reads(*passes: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Union of read passes where a later pass overrides an earlier one."""
    tagged = [p.select(*key, value).withColumn("__pass", F.lit(i)) for i, p in enumerate(passes)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(*key).agg(F.max(F.struct("__pass", value)).alias("m")).select(*key, F.col(f"m.{value}").alias(value))


def winning_side(reads: DataFrame, keys: Sequence[str], side: str, exact: str, score: str) -> DataFrame:
    """Evidence vote per capture (an exact read counts 10), keeping only the winning side's reads."""
    votes = reads.groupBy(*keys, side).agg(F.sum(F.when(F.col(exact), 10.0).otherwise(F.col(score))).alias("__v"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("__v")).alias("loss"), F.col(side).alias("s"))).alias("b"))
    return reads.join(best.select(*keys, F.col("b.s").alias(side)), [*keys, side], "left_semi")


def reconcile_scales(boards: DataFrame, keys: Sequence[str], scale: str) -> DataFrame:
    """Median board scale and relative spread; a capture shows a handful of boards."""
    got = boards.groupBy(*keys).agg(
        F.percentile(scale, 0.5).alias("scale"), (F.max(scale) - F.min(scale)).alias("__w"), F.count(F.lit(1)).alias("boards")
    )
    return got.select(*keys, "boards", "scale", F.try_divide("__w", F.col("scale")).alias("rel_spread"))


def judge_board(rms: str, skew: str, fx: str):
    """(ok, reason) for a fitted board."""
    reason = (
        F.when(F.col(rms) > 1.5, "rms")
        .when(F.abs(F.col(skew)) > 10.0, "skew")
        .when(~F.col(fx).between(0.02, 50.0), "scale")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))
