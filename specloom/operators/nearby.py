"""Points within a radius, through a grid: boards seen twice, duplicate detections.

Each point asks its own and the eight neighbouring cells of a grid as wide as its reach rounded up
to a power of two, so every pair meets by an equi-join on cells and is checked exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def near_pairs(points: DataFrame, keys: Sequence[str], point: str, x: str, y: str, reach: str) -> DataFrame:
    """(keys, a, b): every ``a`` that lies closer to ``b`` than ``b``'s reach; a point never meets itself.

    Points without a place or a positive reach ask nothing; without a place they are not found either.
    """
    level = F.ceil(F.log2(reach)).cast("int")
    cell = lambda c, of: F.floor(F.col(c) / F.pow(F.lit(2.0), of)).cast("long")
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    asks = placed.where(F.col(reach) > 0).withColumn("__level", level)
    levels = asks.groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))  # powers of two: a few dozen at most
    held = placed.join(levels, list(keys)).withColumn("__level", F.explode("__levels"))
    held = held.select(*keys, "__level", cell(x, F.col("__level")).alias("__cx"), cell(y, F.col("__level")).alias("__cy"), F.col(point).alias("a"), F.col(x).alias("__ax"), F.col(y).alias("__ay"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = asks.withColumn("__s", F.explode(steps)).select(
        *keys, "__level", (cell(x, F.col("__level")) + F.col("__s.i")).alias("__cx"), (cell(y, F.col("__level")) + F.col("__s.j")).alias("__cy"),
        F.col(point).alias("b"), F.col(x).alias("__bx"), F.col(y).alias("__by"), F.col(reach).alias("__reach"),
    )
    met = asked.join(held, [*keys, "__level", "__cx", "__cy"]).where(F.col("a") != F.col("b"))
    dx, dy = F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")
    return met.where(F.sqrt(dx * dx + dy * dy) < F.col("__reach")).select(*keys, "a", "b")


def first_of_near(points: DataFrame, keys: Sequence[str], point: str, x: str, y: str, reach: str) -> DataFrame:
    """(keys, point, same_as): the points in order of ``point``; one that lies within its reach of an
    earlier kept point is that point seen again (the earliest such), the others are kept (NULL).

    Whether a point stays depends on those before it, so verdicts spread round by round: each round
    settles every point whose earlier neighbours are settled. Point numbers differ within the keys.
    """
    keys = list(keys)
    pairs = settle(near_pairs(points, keys, point, x, y, reach).where("a < b"))
    open_ = points.select(*keys, F.col(point).alias("b"))
    done = None
    while True:
        if done is None:
            judged = pairs.withColumn("kept", F.lit(None).cast("boolean"))
        else:
            verdict = done.select(*keys, F.col("b").alias("a"), F.col("same_as").isNull().alias("kept"))
            judged = pairs.join(verdict, [*keys, "a"], "left")
        # a kept neighbour decides at once if it is the earliest that can be; otherwise all must be settled
        state = judged.groupBy(*keys, "b").agg(F.min(F.when(F.col("kept"), F.col("a"))).alias("hit"), F.min(F.when(F.col("kept").isNull(), F.col("a"))).alias("waits"))
        told = open_.join(state, [*keys, "b"], "left")
        ready = F.col("waits").isNull() | (F.col("hit") < F.col("waits"))
        told = settle(told.select(*keys, "b", F.col("hit").alias("same_as"), F.coalesce(ready, F.lit(False)).alias("ready")))
        new = told.where("ready").drop("ready")
        done = new if done is None else done.unionByName(new)
        open_ = told.where("NOT ready").select(*keys, "b")
        if open_.isEmpty():
            return done.withColumnRenamed("b", point)
