"""Column builders for one spectrum per row, held as an array of numbers.

Everything stays in JVM expressions.  ``let`` binds a sub-result once, because an
expression written inside a lambda would be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FIRST_NM, LAST_NM, RAW_BANDS = 900.0, 1700.0, 224
KEPT_FROM, KEPT_TO = 8, 200
ABSORBANCE_FLOOR = 1e-4
SNV_FLAT = 1e-6
SG_WINDOW, SG_POLY = 11, 2


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def doubles(c: Column | str) -> Column:
    return as_col(c).cast("array<double>")


def wavelengths(raw: int = RAW_BANDS, lo: int = KEPT_FROM, hi: int = KEPT_TO) -> Column:
    """Wavelength of every kept band on the linear axis of the sensor."""
    step = (LAST_NM - FIRST_NM) / (raw - 1)
    return F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.lit(FIRST_NM) + i * F.lit(step))


def band_select(c: Column | str, lo: int | None = None, hi: int | None = None) -> Column:
    """Bands lo..hi-1 by zero-based index."""
    a, lo = as_col(c), lo or 0
    length = (F.lit(hi) if hi is not None else F.size(a)) - lo
    return F.slice(a, F.lit(lo + 1), length)


def absorbance(x: Column | str, floor: float = ABSORBANCE_FLOOR) -> Column:
    """-log10(max(x, floor)); NaN stays NaN and NULL stays NULL."""
    x = as_col(x).cast("double")
    return F.when(x.isNull(), x).when(F.isnan(x), x).otherwise(-F.log10(F.greatest(x, F.lit(floor))) + F.lit(0.0))


def absorbance_spectrum(c: Column | str) -> Column:
    return F.transform(doubles(c), lambda x: absorbance(x))


def snv(c: Column | str) -> Column:
    """Standard normal variate: (x - mean) / population std over non-NaN entries.

    A spectrum with no spread comes back as zeros.
    """

    def normalise(a: Column) -> Column:
        seen = F.filter(a, lambda x: ~F.isnan(x))
        n = F.size(seen).cast("double")
        return let(
            F.try_divide(total(seen), n),
            lambda m: let(
                F.sqrt(F.try_divide(total(F.transform(seen, lambda x: (x - m) * (x - m))), n)),
                lambda s: F.when(s > SNV_FLAT, F.transform(a, lambda x: (x - m) / s)).otherwise(
                    F.transform(a, lambda x: F.lit(0.0))
                ),
            ),
        )

    return let(doubles(c), normalise)


def savgol_weights(deriv: int, window: int = SG_WINDOW, poly: int = SG_POLY) -> np.ndarray:
    """Row r holds the weights that give the fitted derivative at window position r.

    The least-squares polynomial over a window is linear in the samples; row
    ``window // 2`` serves the interior, the other rows the two edges.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    at = np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(at, poly + 1, increasing=True))
    powers = np.arange(poly + 1)
    falling = np.array([np.prod([p - j for j in range(deriv)]) if p >= deriv else 0.0 for p in powers], float)
    basis = falling * np.power(at[:, None].astype(float), np.maximum(powers - deriv, 0))
    return basis @ fit


def savgol(c: Column | str, deriv: int = 1, window: int = SG_WINDOW, poly: int = SG_POLY) -> Column:
    """Savitzky-Golay smoothing derivative with polynomial edges, unit spacing."""
    w = savgol_weights(deriv, window, poly)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
    half = window // 2

    def filtered(a: Column) -> Column:
        last = F.size(a) - window

        def edge(i: Column) -> Column:
            start = F.greatest(F.lit(0), F.least(i - half, last))
            return dot(F.slice(a, start + 1, F.lit(window)), F.get(rows, i - start))

        def inner(i: Column) -> Column:
            # Plain taps read the array in place; slices would copy it for every band.
            taps = [F.get(a, i + (k - half)) * float(v) for k, v in enumerate(w[half]) if v]
            return sum(taps[1:], taps[0])

        return F.transform(
            a, lambda x, i: F.when((i >= half) & (i <= last + half), inner(i)).otherwise(edge(i))
        )

    return let(doubles(c), filtered)


def spectrum_pipeline(
    c: Column | str, deriv: int = 0, window: int = SG_WINDOW, poly: int = SG_POLY,
    bands: tuple[int, int] | None = None,
) -> Column:
    """Band range, then SNV, then the derivative, always in this order."""
    a = band_select(c, *bands) if bands else as_col(c)
    a = snv(a)
    return savgol(a, deriv, window, poly) if deriv else a


def patch_pixel_pipeline(c: Column | str, inside: Column | str, deriv: int = 0, **kw) -> Column:
    """Spectrum pipeline of one patch pixel; non-finite values and pixels outside are 0."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    done = spectrum_pipeline(c, deriv, **kw)
    clean = F.transform(done, lambda x: F.when(bad(x), 0.0).otherwise(x))
    return F.when(as_col(inside), clean).otherwise(F.transform(as_col(c), lambda x: F.lit(0.0)))


def one_hot(y: Column | str, n: int) -> Column:
    y = as_col(y)
    return F.array(*[(y == i).cast("double") for i in range(n)])


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
