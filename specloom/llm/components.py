"""Connected components of a link table, in rounds of star contraction.

Each round hangs every node's larger neighbours on its smallest one, then hangs all smaller ones
together; the links never grow in number and the depth shrinks by a power. A node with many links
is met by an aggregate with partial sums and by a sort-merge join that splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    below = links.join(least, "u")
    return below.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every linked node with the smallest node it reaches. Unlinked nodes have no row.

    Null ends and self-links are left out; repeated links count once; an empty table gives no row.
    """
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = staged(now, "links")
    seen = _fingerprint(now)
    while seen[0]:
        now = staged(_small_star(_large_star(now)), "links")
        if (then := _fingerprint(now)) == seen:
            break
        seen = then
    roots = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
