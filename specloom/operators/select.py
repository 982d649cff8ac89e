"""View selection, exclusion, class ids, three-state labels and small set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selection(
    isin: Mapping[str, Sequence] | None = None, at_most: Mapping[str, float] | None = None,
    at_least: Mapping[str, float] | None = None,
) -> Column:
    """Conjunction of optional IN-lists and range gates; a gate of None means no filter."""
    tests = [F.col(c).isin(list(v)) for c, v in (isin or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def take(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def exclude(df: DataFrame, column: str, values: Sequence, keep_all: bool = False) -> DataFrame:
    """Drop the excluded strata unless the escape hatch is open."""
    return df if keep_all or not values else df.where(~F.col(column).isin(list(values)))


def dense_class_id(kept: Sequence, column: str) -> Column:
    """Position in the kept list; -1 for anything else."""
    branches = F.lit(-1)
    for i, v in reversed(list(enumerate(kept))):
        branches = F.when(F.col(column) == v, i).otherwise(branches)
    return branches.cast("int")


def restrict_classes(label: str, keep: Sequence[int], known: Sequence[int] | None = None) -> Column:
    """Renumber the kept class ids from 0; everything else becomes -1."""
    if len(set(keep)) < 2:
        raise ValueError("a task needs at least two classes")
    if known is not None and not set(keep) <= set(known):
        raise ValueError(f"unknown classes: {sorted(set(keep) - set(known))}")
    return dense_class_id(sorted(set(keep)), label)


def unique_by(df: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per key; a key that occurs twice fails the job."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in carry])
    name = F.concat(F.lit("repeated key: "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    once = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(name).cast("boolean"))
    return got.where(once).select(*keys, *carry)


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """The rows themselves; an empty selection fails the job."""
    found = df.agg(F.count(F.lit(1))).scalar()
    head = df.sparkSession.range(1).select(F.when(found > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: nothing selected")).cast("boolean")).alias("__some"))
    return df.join(F.broadcast(head), F.col("__some")).drop("__some")  # one row, that checks


def three_state(units: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """Attach a label where absence means "never scored", not "negative".

    ``labels`` holds scored units only; ``value`` NULL means scored without the event.
    Adds ``scored`` and ``label`` (1 event, 0 no event, -1 not scored).
    """
    tagged = unique_by(labels, [key], [value]).withColumn("scored", F.lit(True))
    out = units.join(tagged, key, "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    return out.withColumn(
        "label", F.when(~F.col("scored"), -1).otherwise(F.col(value).isNotNull().cast("int")).cast("int")
    )


def usable(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) >= 0)


def orphans(labels: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Labels that name no unit."""
    return labels.join(units.select(key), key, "left_anti")


def unlabelled(units: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return units.join(labels.select(key), key, "left_anti")


def first_per(df: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` as an aggregate, so it combines map-side."""
    packed = F.min(F.struct(F.col(order), *[F.col(c) for c in carry])).alias("__first")
    return df.groupBy(*keys).agg(packed).select(*keys, "__first.*")


def top2_margin(df: DataFrame, keys: Sequence[str], score: str, ident: str) -> DataFrame:
    """Best candidate per key and its lead over the runner-up (first candidate wins ties).

    One row per (keys, ident) goes in.  The two best are kept by aggregates: the best,
    then the best of the rest, so no group is sorted.
    """
    ask = F.struct((-F.col(score)).alias("ask"), F.col(ident).alias("ident"))
    best = df.groupBy(*keys).agg(F.min(ask).alias("__b"))
    rest = (
        df.join(best, list(keys))
        .where(F.col(ident) != F.col("__b.ident"))
        .groupBy(*keys)
        .agg(F.min(ask).alias("__s"))
    )
    out = best.join(rest, list(keys), "left")
    return out.select(
        *keys,
        F.col("__b.ident").alias("best_id"),
        (-F.col("__b.ask")).alias("best"),
        (F.col("__s.ask") - F.col("__b.ask")).alias("margin"),
    )


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value; empty when the dependency holds."""
    return (
        df.groupBy(key)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .where(~F.col("low").eqNullSafe(F.col("high")))
    )


def in_every_cell(df: DataFrame, unit: str, cells: Sequence[str], wanted: int) -> DataFrame:
    """Units present in all ``wanted`` combinations of the cell columns."""
    return df.select(unit, *cells).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("__k")).where(
        F.col("__k") == wanted
    ).select(unit)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_runs(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive integers per key.

    A run starts where ``i - 1`` is missing and ends where ``i + 1`` is missing; both
    are anti-joins, and the k-th start belongs to the k-th end.
    """
    from .ordered import position

    seen = df.select(*keys, F.col(index).cast("bigint").alias("i")).distinct()
    starts = seen.join(seen.withColumn("i", F.col("i") + 1), [*keys, "i"], "left_anti")
    ends = seen.join(seen.withColumn("i", F.col("i") - 1), [*keys, "i"], "left_anti")
    a = position(starts, keys, "i", "i", "__k").withColumnRenamed("i", "first")
    b = position(ends, keys, "i", "i", "__k").withColumnRenamed("i", "last")
    return a.join(b, [*keys, "__k"]).drop("__k")


def format_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text form "0-2, 7-8" of each key's runs, for reports on bands or sensor rows."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("first", one.alias("txt"))))
    return runs.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["txt"]), ", ").alias("runs")
    )


def row_numbers(df: DataFrame, order: str, tiebreak: str, name: str = "row") -> DataFrame:
    """Dense 0-based row number over the whole table in (order, tiebreak) order."""
    from .ordered import position

    return position(df, [], order, tiebreak, name)


