"""Scale of an image from the corners of a board: a regular grid turned, and sampled unlike on the two axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: axes whose pull on image x differs by less than this share cannot be told apart.
AMBIGUOUS = 0.1


def ideal_lattice(order: Column, columns: int) -> tuple[Column, Column]:
    """(column, row) of a corner from its place in row-major order."""
    return order % columns, F.floor(order / columns)


def board_scales(corners: DataFrame, keys: list[str], columns: int, cell: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Pixels per unit along both image axes, the turn, the skew and the misses of every board.

    ``corners`` holds (keys, n, x, y), n the corner's place in row-major order; missing corners leave gaps.
    The least-squares map from lattice to image comes from second moments, so boards are plain aggregates.
    Its rows' norms, cells divided out, do not change when the board turns; skew is what a turned
    rectangular grid cannot have. ``cell`` is the cell's extent on the board axis nearest to image x, then
    on the other. Boards whose corners span no plane have NULL figures.
    """
    if min(cell) <= 0:
        raise ValueError(f"cell sizes must be positive, not {cell}")
    i, j = ideal_lattice(F.col("n"), columns)
    placed = corners.where("n IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumns({"__i": i.cast("double"), "__j": j.cast("double")})
    means = [F.avg(c).alias(f"__m{c.strip('_')}") for c in ("__i", "__j", "x", "y")]
    pairs = [F.covar_pop(a, b).alias(f"__c{a[-1]}{b[-1]}") for a, b in (("__i", "__i"), ("__j", "__j"), ("__i", "__j"), ("__i", "x"), ("__j", "x"), ("__i", "y"), ("__j", "y"))]
    sums = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_corners"), *means, *pairs)
    det = F.col("__cii") * F.col("__cjj") - F.col("__cij") * F.col("__cij")
    spans = F.when(det > 1e-9, det)
    along = lambda of, a, b: F.try_divide(F.col(f"__c{a}{of}") * F.col(f"__c{b}{b}") - F.col(f"__c{b}{of}") * F.col("__cij"), spans)
    fit = sums.withColumns({"__xi": along("x", "i", "j"), "__xj": along("x", "j", "i"), "__yi": along("y", "i", "j"), "__yj": along("y", "j", "i")})
    miss = lambda v: F.col(v) - F.col(f"__m{v}") - F.col(f"__{v}i") * (F.col("__i") - F.col("__mi")) - F.col(f"__{v}j") * (F.col("__j") - F.col("__mj"))
    off = placed.join(fit, keys).groupBy(*keys).agg(F.max(F.hypot(miss("x"), miss("y"))).alias("max_px"), F.sqrt(F.avg(miss("x") * miss("x") + miss("y") * miss("y"))).alias("rms_px"))

    # Naming of the board's axes: the first is the one nearest to image x, and points to the right.
    swap = F.abs("__xj") > F.abs("__xi")
    pick = lambda v: (F.when(swap, F.col(f"__{v}j")).otherwise(F.col(f"__{v}i")), F.when(swap, F.col(f"__{v}i")).otherwise(F.col(f"__{v}j")))
    (x1, x2), (y1, y2) = pick("x"), pick("y")
    named = fit.select(*keys, "n_corners", F.col("__mx").alias("centre_x"), F.col("__my").alias("centre_y"), x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))
    sign = F.when(F.col("x1") < 0, -1.0).otherwise(1.0)
    named = named.withColumns({c: F.col(c) * sign for c in ("y1", "x2", "y2")}).withColumn("x1", F.abs("x1"))
    wide, high = cell
    scan, spatial = F.hypot(F.col("x1") / wide, F.col("x2") / high), F.hypot(F.col("y1") / wide, F.col("y2") / high)
    shear = F.try_divide(F.col("x1") * F.col("y1") / wide**2 + F.col("x2") * F.col("y2") / high**2, scan * spatial)
    return named.join(off, keys).select(
        *keys, "n_corners", scan.alias("px_scan"), spatial.alias("px_spatial"), F.hypot("x1", "x2").alias("step_scan"), F.hypot("y1", "y2").alias("step_spatial"),
        F.degrees(F.atan2("y1", "x1")).alias("theta_deg"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shear)))).alias("skew_deg"),
        (F.abs(F.abs("x2") - F.abs("x1")) < AMBIGUOUS * F.abs("x1")).alias("axis_ambiguous"), "rms_px", "max_px", "centre_x", "centre_y",
    )
