"""Cutting one rectified patch per view out of a cube, and well occupancy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .collapse import mean_vector_skipnan
from ..functions.spectral import dot, let, spectrum_pipeline, total, vector_literal
from .masks import _components
from .ordered import exact_percentiles
from .plate import bbox

# Patch size and log floor.
PATCH_H, PATCH_W = 128, 64
FLOOR = 1e-4


def working_pixels(cube: DataFrame, width: int | Column) -> DataFrame:
    """Working frame of a cube: x runs against the spatial row, y along the scan."""
    return cube.withColumn("x", F.lit(width) - 1 - F.col("row")).withColumn("y", F.col("line"))


def frame_identity(cube: DataFrame, working: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Pixels of a stored working frame (on, x, y, bands) that differ from the cube they were cut from."""
    want = working_pixels(cube, width).select(*on, "x", "y", F.col("bands").alias("__want"))
    both = working.select(*on, "x", "y", "bands").join(want, [*on, "x", "y"], "left")
    return both.where(~F.col("bands").eqNullSafe(F.col("__want"))).drop("__want")


def view_pixels(views: DataFrame, pixels: DataFrame, on: Sequence[str], view: str, width: str, lines: str) -> DataFrame:
    """Pixels of every view's bounding box.

    The boxes are expanded to their columns first, so pixels meet views by an equi-join
    on (capture, x) and only the y range is left to filter.
    """
    box = views.withColumn("__b", bbox(F.col("corners"), F.col(width), F.col(lines))).where("__b IS NOT NULL")
    cols = box.select(
        *on, view, "corners", F.col("__b.x0").alias("x0"), F.col("__b.y0").alias("y0"), F.col("__b.y1").alias("y1"),
        F.explode(F.sequence(F.col("__b.x0"), F.col("__b.x1") - 1)).alias("x"),
    )
    return pixels.join(cols, [*on, "x"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3 x 3 projective map taking four source points to four destination points."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)


def bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; anything that would need a pixel outside the image is NaN."""
    h, w = img.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    padded = np.full((h + 2, w + 2, img.shape[2]), np.nan, np.float32)
    padded[1:-1, 1:-1] = img
    at = lambda r, c: padded[np.clip(r + 1, 0, h + 1), np.clip(c + 1, 0, w + 1)]
    mix = lambda a, b, t: np.where(t == 0, a, np.where(t == 1, b, a * (1 - t) + b * t))
    return mix(mix(at(y0, x0), at(y0, x0 + 1), fx), mix(at(y0 + 1, x0), at(y0 + 1, x0 + 1), fx), fy)


def cut_patches(boxed: DataFrame, on: Sequence[str], view: str, height: int = PATCH_H, width: int = PATCH_W) -> DataFrame:
    """Warp every view's quad to a height x width patch of absorbance.

    ``boxed`` comes from ``view_pixels`` with (x, y, bands, sat array<boolean>, inside).
    Clipped voxels become NaN before the logarithm; values are kept at half precision.
    One group is one bounding box.  Returns (on, view, py, px, inside, bands, sat_frac,
    clipped_frac, nan_frac, patch_mask_px).
    """
    kinds = ", ".join(f"`{k}` {boxed.schema[k].dataType.simpleString()}" for k in [*on, view])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in [*on, view]}
        x0, y0 = pdf["x"].min(), pdf["y"].min()
        shape = (pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1)
        bands = np.stack(pdf["bands"].to_numpy()).astype(np.float32)
        sat = np.stack(pdf["sat"].to_numpy()).astype(bool)
        img = np.full((*shape, bands.shape[1]), np.nan, np.float32)
        inside = np.zeros(shape, bool)
        spot = (pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0)
        bands[sat] = np.nan
        fine = np.isfinite(bands)
        clipped = float((bands[fine] <= FLOOR).mean()) if fine.any() else 0.0
        img[spot] = -np.log10(np.maximum(bands, FLOOR))
        inside[spot] = pdf["inside"].to_numpy(bool)
        corners = np.array([list(c) for c in pdf["corners"].iloc[0]], float) - [x0, y0]
        back = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]], float), corners)
        py, px = (g.ravel() for g in np.mgrid[:height, :width])
        u, v, s = back @ np.stack([px, py, np.ones_like(px)])
        u, v = (np.where(np.abs(c - np.rint(c)) < 1e-6, np.rint(c), c) for c in (u / s, v / s))
        patch = bilinear(img, u, v).astype(np.float16).astype(np.float32)
        near = (np.rint(v).astype(int), np.rint(u).astype(int))
        ok = (near[0] >= 0) & (near[0] < shape[0]) & (near[1] >= 0) & (near[1] < shape[1])
        mask = np.zeros(len(u), bool)
        mask[ok] = inside[near[0][ok], near[1][ok]]
        mask = _keep_largest(mask.reshape(height, width)).ravel()
        return pd.DataFrame(
            {
                **head, "py": py, "px": px, "inside": mask, "bands": list(patch), "sat_frac": float(sat.mean()),
                "clipped_frac": clipped, "nan_frac": float(np.isnan(patch).mean()), "patch_mask_px": int(mask.sum()),
            }
        )

    return boxed.select(*on, view, "corners", "x", "y", "bands", "sat", "inside").groupBy(*on, view).applyInPandas(
        run,
        f"{kinds}, py int, px int, inside boolean, bands array<float>, sat_frac double, clipped_frac double, "
        "nan_frac double, patch_mask_px int",
    )


def _keep_largest(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected component of a small mask."""
    edge = np.diff(np.pad(mask.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    c, r0 = np.nonzero(edge == 1)
    r1 = np.nonzero(edge == -1)[1] - 1
    if len(c) < 2:
        return mask
    label = _components(c, r0, r1)
    size = np.bincount(label, weights=r1 - r0 + 1)
    out = np.zeros_like(mask)
    for i in np.nonzero(label == size.argmax())[0]:
        out[r0[i] : r1[i] + 1, c[i]] = True
    return out


def mask_mean_spectrum(pixels: DataFrame, keys: Sequence[str], vector: str, size: int, inside: str = "inside") -> DataFrame:
    """Mean over the inside pixels, skipping NaN per band; a band without values is NaN."""
    every = pixels.select(*keys).distinct()
    means = pixels.where(inside).groupBy(*keys).agg(mean_vector_skipnan(vector, size).alias("spectrum"))
    empty = F.array(*[F.lit(float("nan"))] * size)
    return every.join(means, list(keys), "left").withColumn("spectrum", F.coalesce("spectrum", empty))


def patch_scores(pixels: DataFrame, vector: str, mean: np.ndarray, loadings: np.ndarray, deriv: int = 0, inside: str = "inside") -> DataFrame:
    """Adds ``scores``: a fitted basis (bands x components) applied to every inside pixel, in its row.

    Pixels are prepared as spectra are. One outside, or with any missing band, has no scores (NULL).
    """
    whole = F.col(inside) & ~F.exists(vector, lambda x: F.coalesce(F.isnan(x), F.lit(True)))
    at_mean = mean @ loadings
    project = lambda z: F.array(*[dot(z, vector_literal(loadings[:, k])) - float(at_mean[k]) for k in range(loadings.shape[1])])
    return pixels.withColumn("scores", F.when(whole, let(spectrum_pipeline(vector, deriv), project)))


# Fixed values of the display stretch: percentiles of the masked pixels, and the room left beyond them.
DISPLAY_LO, DISPLAY_HI, DISPLAY_PAD = 0.02, 0.98, 0.15


def patch_image(pixels: DataFrame, keys: Sequence[str], vector: str, inside: str = "inside") -> DataFrame:
    """Adds ``shade`` (0..1) and its view's ``invalid``, the share of missing values inside the mask.

    Band means are stretched between percentiles of the view's inside pixels (of all its pixels if it has
    none, which makes it wholly invalid); a pixel without any value has mean 0.
    """
    keys = list(keys)
    seen = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(seen) > 0, total(seen.cast("array<double>")) / F.size(seen)).otherwise(0.0)
    gray = pixels.withColumns({"__gray": mean, "__seen": F.size(seen), "__all": F.size(vector)})
    only = lambda c: F.sum(F.when(F.col(inside), F.col(c)))
    told = gray.groupBy(*keys).agg(F.coalesce(1 - F.try_divide(only("__seen"), only("__all")), F.lit(1.0)).alias("invalid"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("__any"))
    both = gray.join(told, keys)
    ends = exact_percentiles(both.where(F.col(inside) | ~F.col("__any")), keys, "__gray", {"__lo": DISPLAY_LO, "__hi": DISPLAY_HI}).drop("n")
    span = F.col("__hi") - F.col("__lo")
    pad = DISPLAY_PAD * F.greatest(span, F.lit(1e-9))
    shade = (F.col("__gray") - F.col("__lo") + pad) / F.greatest(span + 2 * pad, F.lit(1e-9))
    return both.join(ends, keys).withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))).drop("__gray", "__seen", "__all", "__any", "__lo", "__hi")


def otsu(df: DataFrame, keys: Sequence[str], gray: str) -> DataFrame:
    """Otsu's cut of 0..255 gray levels per key, from the 256-bin histogram.

    The first level with the largest between-class variance wins.
    """
    hist = df.groupBy(*keys, F.col(gray).alias("__g")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    mass = F.col("__n") * F.col("__g")
    run = hist.select(
        *keys, "__g", F.sum("__n").over(upto).alias("w0"), F.sum(mass).over(upto).alias("m0"),
        F.sum("__n").over(whole).alias("w"), F.sum(mass).over(whole).alias("m"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - F.try_divide(F.col("m") - F.col("m0"), w1)
    spread = F.coalesce(F.col("w0") * w1 * gap * gap / (F.col("w") * F.col("w")), F.lit(0.0))
    best = run.groupBy(*keys).agg(F.min(F.struct((-F.round(spread, 9)).alias("loss"), "__g")).alias("b"))
    return best.select(*keys, F.col("b.__g").alias("cut"))


def occupancy(interior: DataFrame, capture: Sequence[str], well: str, gray: str, clip: str, mode: str) -> DataFrame:
    """Share of each well's interior that reads as kernel.

    ``interior`` holds the pixels inside the wells.  In transmittance a pixel counts
    when its clip share is below one half, in reflectance when it is brighter than the
    cut pooled over the capture's wells.
    """
    cut = otsu(interior, capture, gray)
    lit = F.when(F.col(mode) == "transmittance", F.col(clip) < 0.5).otherwise(F.col(gray) > F.col("cut"))
    return interior.join(cut, list(capture)).groupBy(*capture, well).agg(F.avg(lit.cast("double")).alias("occupancy"))
