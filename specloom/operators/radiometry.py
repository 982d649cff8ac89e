"""Radiometric correction of line-scan cubes.

A cube is one row per (row, line) holding the band array; a calibration frame is one
row per spatial row holding band arrays.  Frames are bounded by the sensor (a few
hundred rows), cubes are not: frames are joined to cubes, cubes are never exploded
except where an order statistic per band needs it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import total
from .collapse import mean_vector
from .ordered import exact_percentiles, null_safe_join

# Fixed values.
FULL_SCALE = 4095
HOT_FACTOR = 3.0
MIN_WHITE_COUNTS = 100.0
MIN_WHITE_SHARE = 0.15
BAND_KEEP_SHARE = 0.5
FILL_NEIGHBOURS = 4
OPEN_BEAM_MAX_CLIP, OPEN_BEAM_PCT, OPEN_BEAM_MIN_ROWS = 0.01, 0.90, 32
OPEN_BEAM_RANGE = (0.80, 1.25)
TAPE_PCT, TAPE_COVERAGE, TAPE_HOT_SHARE = 0.75, 0.75, 0.01
UNPHYSICAL_SHARE = 0.001

NAN = float("nan")


def is_blank(vector: str) -> Column:
    """A line whose every count is zero was never written by the camera."""
    return ~F.exists(F.col(vector), lambda x: x != 0)


def long_bands(cube: DataFrame, vector: str, *keep: str) -> DataFrame:
    return cube.select(*keep, F.posexplode(vector).alias("band", "x"))


def to_frame(long: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, band, value) rows to one array per key; one entry per sensor band."""
    pairs = F.array_sort(F.collect_list(F.struct("band", F.col(value).alias("x"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias(name))


def reference_frame(
    cube: DataFrame, keys: Sequence[str], vector: str, size: int, how: str = "median", name: str = "frame"
) -> DataFrame:
    """Median or mean over the non-blank lines of every (row, band)."""
    lines = cube.where(~is_blank(vector))
    if how == "mean":
        return lines.groupBy(*keys).agg(mean_vector(vector, size).alias(name))
    if how != "median":
        raise ValueError(f"unknown frame statistic {how!r}")
    med = exact_percentiles(long_bands(lines, vector, *keys), [*keys, "band"], "x", {"m": 0.5})
    return to_frame(med, keys, "m", name)


def hot_pixels(dark: DataFrame, row: str, vector: str, factor: float = HOT_FACTOR) -> DataFrame:
    """Frame cells whose dark level exceeds ``factor`` times the frame's median dark.

    A frame has one value per sensor cell, so the built-in exact percentile is safe here.
    """
    every = long_bands(dark, vector, row)
    out = dark.withColumn("__limit", every.agg(F.percentile("x", 0.5) * factor).scalar())
    return out.select(row, F.transform(vector, lambda x: x > F.col("__limit")).alias("hot"))


def white_validity(
    dark: DataFrame, white: DataFrame, row: str, keep_share: float = BAND_KEEP_SHARE, hot_factor: float = HOT_FACTOR
) -> DataFrame:
    """Which (row, band) cells carry usable white signal.

    Takes the frames (row, dark[]) and (row, white[]); returns (row, band, dark, w, hot,
    cell_valid, valid, band_level, band_kept).  A cell is valid at >= 100 counts,
    >= 0.15 of the band's typical row and not hot; a band is kept at >= ``keep_share``
    of the brightest band's median.  All medians run over sensor cells, a bounded set.
    """
    limit = long_bands(dark, "dark", row).agg(F.percentile("x", 0.5) * hot_factor).scalar()
    cells = dark.join(white, row).select(row, F.posexplode(F.arrays_zip("dark", "white")).alias("band", "z"))
    cells = cells.withColumn("__limit", limit).select(
        row,
        "band",
        F.col("z")["dark"].alias("dark"),
        F.col("z")["white"].alias("w"),
        (F.col("z")["dark"] > F.col("__limit")).alias("hot"),
    )
    typical = cells.groupBy("band").agg(F.percentile("w", 0.5).alias("typical"))
    cells = cells.join(typical, "band").withColumn(
        "cell_valid",
        (F.col("w") >= MIN_WHITE_COUNTS) & (F.col("w") >= MIN_WHITE_SHARE * F.col("typical")) & ~F.col("hot"),
    )
    levels = cells.groupBy("band").agg(
        F.coalesce(F.percentile(F.when(F.col("cell_valid"), F.col("w")), 0.5), F.lit(0.0)).alias("band_level")
    )
    bands = levels.withColumn("__peak", levels.agg(F.max("band_level")).scalar()).select(
        "band", "band_level", (F.col("band_level") >= keep_share * F.col("__peak")).alias("band_kept")
    )
    return cells.join(bands, "band").select(
        row, "band", "dark", "w", "hot", "cell_valid", (F.col("cell_valid") & F.col("band_kept")).alias("valid"),
        "band_level", "band_kept",
    )


def _field(name: str):
    return lambda p: p[name]


def calibration(validity: DataFrame, row: str) -> DataFrame:
    """One row per spatial row with the arrays (dark, white, valid, cell_valid)."""
    cell = F.array_sort(F.collect_list(F.struct("band", "dark", F.col("w").alias("white"), "valid", "cell_valid")))
    got = validity.groupBy(row).agg(cell.alias("c"))
    return got.select(row, *[F.transform("c", _field(n)).alias(n) for n in ("dark", "white", "valid", "cell_valid")])


def white_summary(validity: DataFrame, row: str) -> DataFrame:
    """Peak band, dropped bands, invalid share and dead rows of a white reference."""
    bands = validity.groupBy("band").agg(F.max("band_level").alias("band_level"), F.max("band_kept").alias("band_kept"))
    rows = validity.groupBy(row).agg(F.max("valid").alias("alive"))
    best = F.min(F.struct((-F.col("band_level")).alias("a"), "band"))["band"]
    return bands.agg(
        best.alias("peak_band"), F.count_if("band_kept").alias("bands_kept"), F.count_if(~F.col("band_kept")).alias("bands_dropped")
    ).select(
        "*",
        rows.agg(F.count_if(~F.col("alive"))).scalar().alias("dead_rows"),
        validity.agg(F.avg((~F.col("valid")).cast("double"))).scalar().alias("invalid_frac"),
    )


def white_gain_noise(white_cube: DataFrame, row: str, vector: str, size: int, validity: DataFrame) -> DataFrame:
    """Relative gain noise std / sqrt(lines) / max(w, 1) over valid cells, median and p99 in percent."""
    at = lambda i: F.get(F.col(vector), F.lit(i)).cast("double")
    spread = white_cube.groupBy(row).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.array(*[F.stddev_pop(at(i)) for i in range(size)]).alias("__sd")
    )
    cells = spread.select(row, "__n", F.posexplode("__sd").alias("band", "sd"))
    good = cells.join(validity.where("valid").select(row, "band", "w"), [row, "band"])
    rel = good.select((F.col("sd") / F.sqrt("__n") / F.greatest("w", F.lit(1.0)) * 100).alias("rel"))
    return rel.agg(
        F.count(F.lit(1)).alias("n"), F.percentile("rel", 0.5).alias("median_pct"), F.percentile("rel", 0.99).alias("p99_pct")
    )


def transmittance(
    cube: DataFrame, frames: DataFrame, row: str, vector: str, k: float = 1.0, name: str = "t"
) -> DataFrame:
    """(raw - dark_long) / white * k; negatives are kept and invalid cells are NaN.

    ``frames`` holds (row, dark, white, valid) arrays: one row per spatial row, which
    Spark broadcasts on its own while it is under the session's threshold.
    """
    value = lambda x, i: F.when(
        F.get("valid", i), (x.cast("double") - F.get("dark", i)) / F.get("white", i) * F.lit(float(k))
    ).otherwise(F.lit(NAN))
    return cube.join(frames, row).withColumn(name, F.transform(vector, value)).drop("dark", "white", "valid", "cell_valid")


def dark_subtract(cube: DataFrame, dark: DataFrame, row: str, vector: str) -> DataFrame:
    """raw - dark, clipped at zero and truncated to whole counts."""
    out = cube.join(dark, row)
    return out.withColumn(
        vector, F.transform(vector, lambda x, i: F.floor(F.greatest(x.cast("double") - F.get("dark", i), F.lit(0.0))))
    ).drop("dark")


def white_correct(cube: DataFrame, white: DataFrame, row: str, vector: str, name: str = "r") -> DataFrame:
    """Dark-subtracted counts over the row's white reference."""
    out = cube.join(white, row)
    return out.withColumn(
        name, F.transform(vector, lambda x, i: F.try_divide(x.cast("double"), F.get("white", i)))
    ).drop("white")


NEIGHBOURS = [(dr, db) for dr in (-1, 0, 1) for db in (-1, 0, 1) if dr or db]


def fill_sources(validity: DataFrame, row: str, least: int = FILL_NEIGHBOURS, keys: Sequence[str] = ()) -> DataFrame:
    """(row, band, src_row, src_band) for every invalid kept cell with enough valid neighbours.

    The eight offsets are exploded and equi-joined, so no range join is planned, and
    only original valid cells serve as sources.  Sets of cells told apart by ``keys`` never meet.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("db")) for a, b in NEIGHBOURS])
    bad = validity.where(~F.col("valid") & F.col("band_kept")).select(*keys, row, "band", F.inline(offsets))
    want = bad.select(
        *keys, row, "band", (F.col(row) + F.col("dr")).alias("src_row"), (F.col("band") + F.col("db")).alias("src_band")
    )
    good = validity.where("valid").select(*keys, F.col(row).alias("src_row"), F.col("band").alias("src_band"))
    near = want.join(good, [*keys, "src_row", "src_band"])
    enough = near.groupBy(*keys, row, "band").agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= least)
    return near.join(enough.select(*keys, row, "band"), [*keys, row, "band"])


def fill_bad_cells(cube: DataFrame, sources: DataFrame, row: str, line: str, vector: str) -> DataFrame:
    """Replace isolated bad cells by the mean of their valid neighbours, line by line.

    Each line's sources meet on (source row); the sums come back keyed by (row, line),
    so the traffic is one number per filled cell and line.
    """
    s = sources.select(F.col(row).alias("__to"), "band", F.col("src_row").alias(row), "src_band")
    values = cube.join(s, row).select("__to", line, "band", F.get(vector, F.col("src_band")).alias("x"))
    means = values.groupBy("__to", line, "band").agg(F.avg("x").alias("x"))
    fixes = means.groupBy(F.col("__to").alias(row), line).agg(
        F.map_from_entries(F.collect_list(F.struct("band", "x"))).alias("__fix")
    )
    out = null_safe_join(cube, fixes, [row, line], "left")
    patched = F.transform(vector, lambda x, i: F.coalesce(F.try_element_at(F.col("__fix"), i), x))
    return out.withColumn(vector, F.when(F.col("__fix").isNull(), F.col(vector)).otherwise(patched)).drop("__fix")


def band_mean(cube: DataFrame, vector: str, kept: str | None = None, clipped: str | None = None) -> DataFrame:
    """Mean over kept finite bands per pixel (NaN if none) and the share of clipped kept bands."""
    use = F.transform(
        vector, lambda x, i: F.when((F.get(kept, i) if kept else F.lit(True)) & ~F.isnan(x), x.cast("double"))
    )
    seen = F.filter(use, lambda x: x.isNotNull())
    out = cube.withColumn(
        "band_mean", F.coalesce(F.try_divide(total(seen), F.size(seen).cast("double")), F.lit(NAN))
    )
    if clipped:
        flags = F.transform(
            clipped, lambda x, i: F.when(F.get(kept, i) if kept else F.lit(True), x.cast("int").cast("double"))
        )
        flags = F.filter(flags, lambda x: x.isNotNull())
        out = out.withColumn("clip_frac", F.try_divide(total(flags), F.size(flags).cast("double")))
    return out


def open_beam_check(
    raw: DataFrame, row: str, vector: str, frames: DataFrame, k: float = 1.0,
    min_rows: int = OPEN_BEAM_MIN_ROWS,
) -> DataFrame:
    """An empty light path must read 1: median T of the brightest tenth per usable band.

    ``frames`` holds (row, dark, white, cell_valid) arrays.  A band is usable when at
    most 1 % of its voxels clip and enough rows are valid.  One row per band with the
    clip share and, where usable, the median T.
    """
    long = raw.join(frames, row).select(
        row,
        F.posexplode(F.arrays_zip(F.col(vector).alias("x"), "dark", "white", "cell_valid")).alias("band", "z"),
    ).select(
        row, "band", F.col("z")["x"].cast("double").alias("x"), F.col("z")["cell_valid"].alias("ok"),
        ((F.col("z")["x"].cast("double") - F.col("z")["dark"]) / F.col("z")["white"] * F.lit(float(k))).alias("t"),
    )
    rows = frames.select(F.posexplode("cell_valid").alias("band", "ok")).groupBy("band").agg(
        F.count_if("ok").alias("valid_rows")
    )
    clip = long.groupBy("band").agg(F.avg((F.col("x") >= FULL_SCALE).cast("double")).alias("clip_frac")).join(rows, "band")
    usable = clip.where((F.col("clip_frac") <= OPEN_BEAM_MAX_CLIP) & (F.col("valid_rows") >= min_rows)).select("band")
    cand = long.where("ok").join(usable, "band")
    bright = exact_percentiles(cand, ["band"], "x", {"cut": OPEN_BEAM_PCT}).drop("n")
    med = exact_percentiles(cand.join(bright, "band").where("x >= cut"), ["band"], "t", {"median_t": 0.5}).drop("n")
    return clip.join(med, "band", "left")


def open_beam_verdict(per_band: DataFrame) -> DataFrame:
    """Median over the usable bands and whether it lies in the accepted range."""
    lo, hi = OPEN_BEAM_RANGE
    m = per_band.agg(F.count("median_t").alias("bands_used"), F.percentile("median_t", 0.5).alias("median"))
    return m.withColumn("ok", F.col("median").between(lo, hi))


def tape_white(
    darksub: DataFrame, row: str, line: str, vector: str, tape: DataFrame,
    pct: float = TAPE_PCT, coverage: float = TAPE_COVERAGE,
) -> DataFrame:
    """White level per trusted (row, band): a percentile of the tape pixels.

    ``tape`` lists the (row, line) pixels on the tape.  A row is trusted at
    ``coverage`` times the median count of covered rows; if none is, every covered
    row is.  Returns (row, band, white).
    """
    counts = tape.groupBy(row).agg(F.count(F.lit(1)).alias("__k"))
    limit = exact_percentiles(counts, [], "__k", {"m": 0.5}).select(F.col("m") * coverage).scalar()
    trusted = counts.withColumn("__limit", limit).where(F.col("__k") >= F.col("__limit"))
    on_tape = darksub.join(tape.select(row, line), [row, line], "left_semi").join(trusted.select(row), row, "left_semi")
    got = exact_percentiles(long_bands(on_tape, vector, row), [row, "band"], "x", {"white": pct})
    return got.select(row, "band", "white")


def tape_saturation(clipped: DataFrame, row: str, line: str, vector: str, size: int, tape: DataFrame) -> DataFrame:
    """Clipped share on the tape and off it, the peak band and the number of hot bands.

    ``vector`` holds one boolean per band.  One pass over the cube per side.
    """
    flagged = null_safe_join(clipped, tape.select(row, line, F.lit(True).alias("__on")).distinct(), [row, line], "left")
    at = lambda i: F.avg(F.get(F.col(vector), F.lit(i)).cast("int").cast("double"))
    side = flagged.groupBy(F.coalesce("__on", F.lit(False)).alias("on_tape")).agg(
        F.array(*[at(i) for i in range(size)]).alias("share")
    )
    share = F.col("share")
    return side.select(
        "on_tape",
        (total(share) / F.size(share).cast("double")).alias("clip_frac"),
        (F.array_position(share, F.array_max(share)) - 1).cast("int").alias("peak_band"),
        F.array_max(share).alias("peak_frac"),
        F.size(F.filter(share, lambda x: x > TAPE_HOT_SHARE)).alias("hot_bands"),
    )


def tape_span(tape: DataFrame, line: str) -> DataFrame:
    return tape.agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"))


def unphysical_share(corrected: DataFrame, vector: str) -> DataFrame:
    """Share of valid voxels above 1, and whether it deserves a warning."""
    valid = F.filter(vector, lambda x: ~F.isnan(x))
    counts = corrected.select(F.size(valid).alias("n"), F.size(F.filter(valid, lambda x: x > 1)).alias("k"))
    share = F.try_divide(F.sum("k").cast("double"), F.sum("n").cast("double"))
    return counts.agg(share.alias("above_one")).withColumn("warn", F.col("above_one") > UNPHYSICAL_SHARE)


def line_period(stamps: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Median time between consecutive lines; NULL under three stamps.

    Neighbouring stamps come from the running-total helper, so a long recording is not
    sorted in one task.
    """
    from .ordered import cumulate

    seen = stamps.groupBy(*keys, F.col(ts).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    gaps = cumulate(seen, keys, "__t", ["__n"])
    # A stamp shared by m lines adds m - 1 gaps of zero next to the gap to its predecessor.
    first = gaps.where("prev_value IS NOT NULL").select(
        *keys, (F.col("__t") - F.col("prev_value")).cast("double").alias("gap"), F.lit(1).cast("bigint").alias("w")
    )
    ties = gaps.where("__n > 1").select(*keys, F.lit(0.0).alias("gap"), (F.col("__n") - 1).alias("w"))
    weighted = first.unionByName(ties).groupBy(*keys, "gap").agg(F.sum("w").alias("__w"))
    ranked = cumulate(weighted, keys, "gap", ["__w"])
    mid = (F.col("__w_total") - 1) / F.lit(2.0)
    pick = lambda i: F.max(F.when((F.col("__w_before") <= i) & (i < F.col("__w_before") + F.col("__w")), F.col("gap")))
    out = ranked.groupBy(*keys).agg(
        F.max("__w_total").alias("__g"), ((pick(F.floor(mid)) + pick(F.ceil(mid))) / 2.0).alias("period")
    )
    return out.select(*keys, (F.col("__g") + 1).alias("lines"), F.when(F.col("__g") >= 2, F.col("period")).alias("period"))


def drift_warnings(measured: DataFrame, period: str, base_period: float, lines: str, base_lines: int) -> DataFrame:
    """Flags a line period off by more than 5 % or a line count off by more than 10 %."""
    off = lambda c, b: F.abs(F.col(c) - b) / F.lit(float(b))
    return measured.withColumn("period_drift", off(period, base_period) > 0.05).withColumn(
        "lines_drift", off(lines, base_lines) > 0.10
    )


# ------------------------------------------------------------------ resampling

def resampled_size(n: int, factor: float) -> tuple[int, float]:
    """Output size and the factor actually achieved."""
    new = max(1, round(n * factor))
    return new, new / n


def axis_weights(spark, n: int, factor: float) -> DataFrame:
    """(src, out, w): contribution of every source position to every output position.

    Shrinking integrates the overlap of the output footprint with each source cell;
    growing blends the two nearest cell centres, clamped at the ends.
    """
    new, _ = resampled_size(n, factor)
    out = spark.range(new).select(F.col("id").alias("out"))
    if new == n:
        return out.select(F.col("out").alias("src"), "out", F.lit(1.0).alias("w"))
    step = n / new
    if factor < 1.0:
        lo, hi = F.col("out") * step, (F.col("out") + 1) * step
        src = out.select("out", lo.alias("lo"), hi.alias("hi"), F.explode(
            F.sequence(F.floor(lo), F.least(F.ceil(hi) - 1, F.lit(n - 1)))).alias("src"))
        w = F.least(F.col("hi"), F.col("src") + 1) - F.greatest(F.col("lo"), F.col("src"))
        return src.select("src", "out", w.cast("double").alias("w")).where("w > 1e-9")
    at = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (F.col("out") + 0.5) * step - 0.5))
    left = F.floor(at)
    return out.select("out", at.alias("at"), left.alias("l")).select(
        "out",
        F.inline(F.array(
            F.struct(F.col("l").alias("src"), (1 - (F.col("at") - F.col("l"))).alias("w")),
            F.struct(F.least(F.col("l") + 1, F.lit(n - 1)).alias("src"), (F.col("at") - F.col("l")).alias("w")),
        )),
    ).where("w > 0").groupBy("src", "out").agg(F.sum("w").alias("w")).select("src", "out", "w")


def axis_weights_by(dims: DataFrame, key: str, n: str = "n", factor: str = "factor") -> DataFrame:
    """(key, src, out, w) like ``axis_weights``, for every key's own length and factor.

    An output position reaches a handful of sources, so the table has a few rows a position.
    """
    size, f = F.col(n), F.col(factor)
    outs = dims.select(key, n, factor, F.greatest(F.bround(size * f), F.lit(1)).cast("long").alias("new"))
    outs = outs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new") - 1)).alias("out"))
    outs = outs.withColumn("step", size / F.col("new"))
    lo, hi = F.col("out") * F.col("step"), (F.col("out") + 1) * F.col("step")
    pair = lambda s, w: F.struct(s.cast("long").alias("src"), w.cast("double").alias("w"))
    shrink = F.transform(
        F.sequence(F.floor(lo), F.least(F.ceil(hi) - 1, size.cast("long") - 1)),
        lambda s: pair(s, F.least(hi, s.cast("double") + 1) - F.greatest(lo, s.cast("double"))),
    )
    at = F.greatest(F.lit(0.0), F.least(size - F.lit(1.0), (F.col("out") + 0.5) * F.col("step") - 0.5))
    left = F.floor(at)
    grow = F.array(pair(left, 1 - (at - left)), pair(F.least(left + 1, size.cast("long") - 1), at - left))
    same = F.array(pair(F.col("out"), F.lit(1.0)))
    weights = F.when(F.col("new") == size, same).when(f < 1, shrink).otherwise(grow)
    got = outs.select(key, "out", F.inline(F.filter(weights, lambda p: p["w"] > 1e-9)))
    return got.groupBy(key, "src", "out").agg(F.sum("w").alias("w"))


def resample_axis_by(
    cube: DataFrame, axis: str, key: str, keys: Sequence[str], means: Sequence[str], sets: Sequence[str], size: int, weights: DataFrame
) -> DataFrame:
    """Resample one axis by the weights of each key, all array columns in one pass.

    Arrays in ``means`` become weighted means (NaN in a source makes the output NaN), boolean arrays
    in ``sets`` are set where any source is.  ``keys`` are the other columns that stay.
    """
    spread = cube.join(weights.withColumnRenamed("src", axis), [key, axis])
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    mean = lambda c: F.array(*[F.sum(at(c, i).cast("double") * F.col("w")) / F.sum("w") for i in range(size)])
    any_set = lambda c: F.array(*[F.bool_or(at(c, i)) for i in range(size)])
    out = spread.groupBy(key, *keys, F.col("out").alias("__out")).agg(*[mean(c).alias(c) for c in means], *[any_set(c).alias(c) for c in sets])
    return out.withColumnRenamed("__out", axis)


def resample_two_axes(
    cube: DataFrame, dims: DataFrame, key: str, keys: Sequence[str], means: Sequence[str], sets: Sequence[str], size: int,
    axes: Sequence[str] = ("line", "row"),
) -> DataFrame:
    """One axis after the other, each growing or shrinking by its own factor.

    ``dims`` holds, per key, ``n_<axis>`` and ``f_<axis>``.  The weights are separable and sparse, so a
    group is one output position of one axis and never an image.
    """
    for axis, other in (axes, reversed(axes)):
        sized = dims.select(key, F.col(f"n_{axis}").alias("n"), F.col(f"f_{axis}").alias("factor"))
        cube = resample_axis_by(cube, axis, key, [other, *keys], means, sets, size, axis_weights_by(sized, key))
    return cube


def resample_axis(
    cube: DataFrame, axis: str, keys: Sequence[str], vector: str, size: int, weights: DataFrame
) -> DataFrame:
    """Weighted mean of the band arrays over the source positions of each output position.

    NaN in any contributing source makes the output NaN, as interpolation would.
    """
    spread = cube.join(weights.withColumnRenamed("src", axis), axis)
    at = lambda i: F.sum(F.get(F.col(vector), F.lit(i)).cast("double") * F.col("w")) / F.sum("w")
    out = spread.groupBy(*keys, F.col("out").alias("__out")).agg(F.array(*[at(i) for i in range(size)]).alias(vector))
    return out.withColumnRenamed("__out", axis)


def resample_mask(
    mask: DataFrame, axis: str, keys: Sequence[str], vector: str, size: int, weights: DataFrame
) -> DataFrame:
    """Boolean resampling: an output is set if any source that reaches it is set."""
    spread = mask.join(weights.withColumnRenamed("src", axis), axis)
    at = lambda i: F.bool_or(F.get(F.col(vector), F.lit(i)))
    out = spread.groupBy(*keys, F.col("out").alias("__out")).agg(F.array(*[at(i) for i in range(size)]).alias(vector))
    return out.withColumnRenamed("__out", axis)


def scan_scale(px_scan: float, px_spatial: float, reference: str = "spatial") -> tuple[float, float]:
    """(scan, spatial) multipliers that equalise the two pixel scales."""
    if reference == "spatial":
        return px_spatial / px_scan, 1.0
    if reference == "scan":
        return 1.0, px_scan / px_spatial
    raise ValueError(f"unknown reference {reference!r}")


def percentile_stretch(df: DataFrame, value: str, keys: Sequence[str] = (), lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """0..255 gray levels between two percentiles of the finite values."""
    cuts = exact_percentiles(df, keys, value, {"__lo": lo, "__hi": hi}).drop("n")
    if keys:
        out = null_safe_join(df, cuts, keys, "left")
    else:
        both = cuts.select(F.struct("__lo", "__hi")).scalar()
        out = df.withColumn("__c", both).select("*", "__c.*").drop("__c")
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("__lo")) / span))
    return out.withColumn("gray", F.floor(unit * 255).cast("int")).drop("__lo", "__hi")
