"""The data-quality gate: named checks as one-row aggregates over whole tables.

Every check counts its violations; the gate is their union and passes when no row has
any.  Nothing is trained on data that fails it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import total

# Problems that stop a build. An empty well is expected, so a cell without a mask is none.
FATAL = (
    "SHAPE_MISMATCH", "FIT_FAILED", "EMPTY_MASK", "MASK_ERODED_AWAY", "MASK_OFF_LATTICE", "MASK_STRADDLES_CELLS",
    "TWO_MASKS_ONE_CELL",
)


def verdict(counted: DataFrame, name: str, violations: Column) -> DataFrame:
    v = F.coalesce(violations, F.lit(0)).cast("bigint")
    return counted.select(F.lit(name).alias("name"), (v == 0).alias("ok"), v.alias("violations"))


def none_left(bad: DataFrame, name: str) -> DataFrame:
    """Passes when the frame of offenders is empty."""
    return verdict(bad.agg(F.count(F.lit(1)).alias("v")), name, F.col("v"))


def row_ids_dense(df: DataFrame, row: str, name: str = "row ids are 0..N-1") -> DataFrame:
    """Distinct ids from 0 to N-1: checked by count, minimum, maximum and distinct count."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi"), F.count_distinct(row).alias("d"))
    return verdict(c, name, F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n")), 0).otherwise(1))


def row_count_is(df: DataFrame, expected: int, name: str = "row count matches the build record") -> DataFrame:
    return verdict(df.agg(F.abs(F.count(F.lit(1)) - expected).alias("v")), name, F.col("v"))


def same_count(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return verdict(a.agg(F.count(F.lit(1)).alias("n")).withColumn("m", b.agg(F.count(F.lit(1))).scalar()), name, F.abs(F.col("n") - F.col("m")))


def views_per_unit(df: DataFrame, unit: str, expected: int, known_gaps: Sequence = (), name: str = "every unit has its views") -> DataFrame:
    odd = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return none_left(odd.where(~F.col(unit).isin(list(known_gaps))) if known_gaps else odd, name)


def absent(df: DataFrame, unit: str, ids: Sequence, name: str = "known empty wells are absent") -> DataFrame:
    return none_left(df.where(F.col(unit).isin(list(ids))), name)


def one_value_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    odd = df.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a <> b")
    return none_left(odd, name)


def within_domain(df: DataFrame, column: str, domain: Sequence, name: str) -> DataFrame:
    return none_left(df.where(F.col(column).isNull() | ~F.col(column).isin(list(domain))), name)


def spectra_finite(df: DataFrame, vector: str, size: int, name: str = "spectra are finite and complete") -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return none_left(df.where(bad | (F.size(vector) != size)), name)


def recomputed_equal(stored: DataFrame, derived: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Stored and re-derived values agree exactly, NULL and NaN included, on the same keys."""
    a = stored.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__l"))
    b = derived.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    both = a.join(b, list(keys), "full_outer")
    odd = F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))
    return none_left(both.where(odd), name)


def rle_matches(masks: DataFrame, segments: DataFrame, keys: Sequence[str], counts: str, name: str = "mask areas match their runs") -> DataFrame:
    """Decoded area against the plain sum of the odd runs."""
    odd_runs = total(F.transform(counts, lambda n, i: F.when(i % 2 == 1, n.cast("double")).otherwise(0.0)))
    want = masks.select(*keys, odd_runs.cast("bigint").alias("area")).where("area > 0")
    got = segments.groupBy(*keys).agg(F.sum(F.col("r1") - F.col("r0") + 1).alias("area"))
    return recomputed_equal(want, got, keys, "area", name)


def area_outliers(boxes: DataFrame, area: str) -> DataFrame:
    """Masks below half the 0.5 % or above twice the 99.5 % percentile of all areas."""
    from .ordered import exact_percentiles

    cut = exact_percentiles(boxes, [], area, {"lo": 0.005, "hi": 0.995}).select(F.struct("lo", "hi")).scalar()
    return boxes.withColumn("__c", cut).where((F.col(area) < F.col("__c.lo") / 2) | (F.col(area) > F.col("__c.hi") * 2)).drop("__c")


def labels_join(labels: DataFrame, units: DataFrame, key: str, name: str = "labels join to the index") -> DataFrame:
    return none_left(labels.join(units.select(key), key, "left_anti"), name)


def both_classes(scored: DataFrame, label: str, name: str = "both outcomes occur") -> DataFrame:
    c = scored.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    return verdict(c, name, F.when((F.col("a") > 0) & (F.col("b") > 0), 0).otherwise(1))


def several(df: DataFrame, column: str, least: int, name: str) -> DataFrame:
    return verdict(df.agg(F.count_distinct(column).alias("d")), name, F.greatest(F.lit(least) - F.col("d"), F.lit(0)))


def no_leakage(assigned: DataFrame, unit: str, name: str, fold: str = "fold") -> DataFrame:
    return none_left(assigned.groupBy(unit).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).where("a <> b"), name)


def no_fatal(problems: DataFrame, name: str = "no fatal assignment problem") -> DataFrame:
    return none_left(problems.where(F.col("problem").isin(list(FATAL))), name)


def fingerprint_is(files: DataFrame, sha256: str, name: str = "annotation file unchanged") -> DataFrame:
    return none_left(files.where(F.col("sha256") != sha256), name)


def boxes_match(stored: DataFrame, boxes: DataFrame, keys: Sequence[str], name: str = "stored areas and boxes match the masks") -> DataFrame:
    """Stored (area, c_min, c_max, r_min, r_max) against those of the decoded masks."""
    said = lambda d: d.select(*keys, F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("area", "c_min", "c_max", "r_min", "r_max")]).alias("b"))
    return recomputed_equal(said(stored), said(boxes), keys, "b", name)


def single_component(stats: DataFrame, name: str = "masks are one component") -> DataFrame:
    return none_left(stats.where("n_components > 1"), name)


def off_border(boxes: DataFrame, h: str, w: str, name: str = "masks stay off the border") -> DataFrame:
    touches = (F.col("c_min") <= 0) | (F.col("r_min") <= 0) | (F.col("c_max") >= F.col(w) - 1) | (F.col("r_max") >= F.col(h) - 1)
    return none_left(boxes.where(touches), name)


def more_than_one(df: DataFrame, column: str, name: str) -> DataFrame:
    return several(df, column, 2, name)


def gate(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(report: DataFrame) -> DataFrame:
    """The report itself, failing the job on the first check that does not hold."""
    return report.withColumn(
        "ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("gate failed: "), F.col("name"))).cast("boolean"))
    )
