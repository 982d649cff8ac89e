"""Per-group clocks, interval-censored events and incidence profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import null_safe_join
from .select import unique_by


def attach_clock(views: DataFrame, clock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join the measured clock ``(keys, time, hours, source)`` onto the views.

    A missing record gives a NULL time, NaN hours and source 'none'; a record without
    a source reads as 'measured'.  The clock holds one row per key (a repeated key fails the job), so
    Spark broadcasts it while it is under the session's broadcast threshold.
    """
    side = unique_by(clock, keys, ["time", "hours", "source"]).select(
        *keys,
        F.col("time").alias("capture_time"),
        F.col("hours").alias("__hours"),
        F.col("source").alias("__source"),
        F.lit(True).alias("__hit"),
    )
    out = null_safe_join(views, side, keys, "left")
    return out.select(
        *views.columns,
        "capture_time",
        F.coalesce("__hours", F.lit(float("nan"))).alias("capture_hours"),
        F.when(F.col("__hit").isNull(), F.lit("none"))
        .otherwise(F.coalesce("__source", F.lit("measured")))
        .alias("capture_time_source"),
    )


def origin(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """First timestamp per group: its t0."""
    return df.groupBy(*keys).agg(F.min(ts).alias("t0"))


def hours_between(start: str, end: str) -> Column:
    """Hours from one timestamp to another, microseconds kept, whatever the session zone."""
    seconds = (F.col(end) - F.col(start)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1000000).cast("bigint").cast("double") / F.lit(3.6e9)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session zone."""
    seconds = (F.col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1000000).cast("bigint")


def hours_since_origin(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """``hours`` since the group's t0, by aggregate and join so no group is sorted."""
    out = null_safe_join(df, origin(df, keys, ts), keys, "left")
    return out.withColumn("hours", hours_between("t0", ts))


def event_interval(units: DataFrame, visits: DataFrame, group: str, day: str, scored: str) -> DataFrame:
    """Bracket each unit's event between two visits of its group: ``(lower, upper]``.

    ``visits`` holds ``(group, visits array<double>)``.  Day 1 starts at 0; no event is
    right-censored at the last visit; an unscored unit gets NaN on both ends.
    """
    out = null_safe_join(units, visits.select(group, "visits"), [group], "left")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    k, v = F.col(day), F.col("visits")
    lower = (
        F.when(~F.col(scored), nan)
        .when(k.isNull(), F.try_element_at(v, F.lit(-1)))
        .when(k == 1, F.lit(0.0))
        .otherwise(F.get(v, k.cast("int") - 2))
    )
    upper = F.when(~F.col(scored), nan).when(k.isNull(), inf).otherwise(F.get(v, k.cast("int") - 1))
    return out.select(*units.columns, lower.alias("lower"), upper.alias("upper"))


def visit_edges(visits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, minimum and maximum hours of the k-th visit over the groups in scope."""
    each = visits.select(*keys, F.posexplode("visits").alias("pos", "hours"))
    return each.groupBy(*keys, (F.col("pos") + 1).alias("visit")).agg(
        F.avg("hours").alias("mean_hours"), F.min("hours").alias("min_hours"), F.max("hours").alias("max_hours")
    )


def incidence_profile(df: DataFrame, group: str, day: str, days: Sequence[int], pooled: str = "all") -> DataFrame:
    """Event counts per day, never, median and modal day and cumulative incidence.

    One row for the pool and one per group, from GROUPING SETS over scored units
    (``day`` NULL = never).  The day domain is fixed and small, so the exact
    percentile buffers hold a handful of values.
    """
    grouped = df.rollup(group).agg(
        F.grouping(group).alias("__pool"),
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(day) == d).alias(f"day{d}") for d in days],
        F.count_if(F.col(day).isNull()).alias("never"),
        F.percentile(F.col(day).cast("double"), 0.5).alias("median_day"),
    )
    counts = F.array(*[F.col(f"day{d}") for d in days])
    germinated = F.col("n") - F.col("never")
    share = lambda x: F.lit(100.0) * x.cast("double") / F.col("n").cast("double")
    upto, cums = F.lit(0).cast("bigint"), []
    for d in days:
        upto = upto + F.col(f"day{d}")
        cums.append(share(upto).alias(f"cum_pct_day{d}"))
    modal = F.element_at(
        F.array(*[F.lit(d) for d in days]), F.array_position(counts, F.array_max(counts)).cast("int")
    )
    return grouped.select(
        F.when(F.col("__pool") == 1, F.lit(pooled)).otherwise(F.col(group).cast("string")).alias("grp"),
        "n",
        *[f"day{d}" for d in days],
        "never",
        germinated.alias("germinated"),
        share(germinated).alias("pct_germinated"),
        "median_day",
        F.when(germinated > 0, modal).alias("modal_day"),
        *cums,
    )
