"""End-to-end correction of raw captures: one plan for all captures of all days.

Cubes are one row per (capture, row, line) with the band array.  Each corrected line carries its
own small quality counts, so quality per capture is an aggregate over narrow columns and never
opens the arrays again; totals of a run are observed while the cube is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.spectral import total
from ..operators import calibration as C
from ..operators import radiometry as R
from ..operators.interpolate import clamp_interpolate
from ..operators.ordered import bracketed_percentiles, exact_percentiles, level_percentile
from ..session import settle, written

# Fixed values.
PREVIEW_FLOOR, PREVIEW_CLIP_SHARE, PREVIEW_LEAST_CLEAN = 1e-4, 0.02, 1000
PREVIEW_LO, PREVIEW_HI = 0.005, 0.995
INTENSITY_LO, INTENSITY_HI = 0.01, 0.99

NAN = float("nan")


@dataclass
class Corrected:
    """The corrected cube with quality counts a line, and one row of figures per capture."""

    cube: DataFrame
    quality: DataFrame


def count_in(vector: str | Column, rule) -> Column:
    return F.size(F.filter(vector, rule)).cast("long")


def raw_figures(cube: DataFrame, vector: str, full_scale: float) -> DataFrame:
    """Lines, blank lines and saturated share of every raw capture."""
    lines = cube.groupBy("capture").agg(
        (F.max("line") + 1).alias("lines"), F.count_if(R.is_blank(vector)).alias("blank_rows"),
        (F.sum(count_in(vector, lambda x: x >= full_scale)) / F.sum(F.size(vector))).alias("saturated_frac"),
    )
    return lines


def open_beam_by_capture(lit: DataFrame, rows: DataFrame, full_scale: float, min_rows: int) -> DataFrame:
    """Median T of the brightest tenth over bands that hardly clip: the light path must read 1.

    ``lit`` holds (capture, set, k, c[], dark[], white[], ok[]): counts, the unmasked frames, valid cells.
    Counts are whole, so one scan counts levels and a second one only opens what lies in the brightest
    tenth; T of a cell takes as many values as the cell has levels.  Without a usable band ``open_beam``
    and ``open_beam_ok`` are NULL.
    """
    cells = lit.select("*", F.posexplode("c").alias("band", "x"))
    levels = cells.groupBy("capture", "set", "band", F.get("ok", F.col("band")).alias("ok"), "x").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("x").isNotNull(), F.col("n"))
    bright = levels.groupBy("capture", "set", "band").agg(
        F.try_divide(F.sum(F.when(F.col("x") >= full_scale, F.col("n")).otherwise(0)), F.sum(known)).alias("clip"),
        F.percentile(F.when(F.col("ok"), F.col("x")), F.lit(R.OPEN_BEAM_PCT), F.col("n")).alias("cut"),
    )
    usable = bright.join(rows, ["set", "band"]).where((F.col("clip") <= R.OPEN_BEAM_MAX_CLIP) & (F.col("valid_rows") >= min_rows) & F.col("cut").isNotNull())
    by_band = F.map_from_entries(F.collect_list(F.struct("band", "cut")))  # a number a band
    cuts = usable.groupBy("capture", "set").agg(by_band.alias("at"), F.max("band").alias("last"))
    cuts = cuts.select("capture", "set", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("at", i)).alias("cuts"))
    band = F.col("band")
    top = lit.join(F.broadcast(cuts), ["capture", "set"]).select("*", F.posexplode("c").alias("band", "x"))
    top = top.where(F.get("ok", band) & (F.col("x") >= F.get("cuts", band)))
    u = (F.col("x") - F.get("dark", band)) / F.get("white", band) * F.col("k")
    per_band = level_percentile(top.select("capture", "band", u.alias("u")).where(~F.isnan("u")), ["capture", "band"], "u", 0.5, "m")
    lo, hi = R.OPEN_BEAM_RANGE
    got = per_band.groupBy("capture").agg(F.count(F.lit(1)).alias("open_beam_bands"), F.percentile("m", 0.5).alias("open_beam"))  # a row a band
    return got.withColumn("open_beam_ok", F.col("open_beam").between(lo, hi))


def stretch_of_clean(pixels: DataFrame, least: int = PREVIEW_LEAST_CLEAN) -> DataFrame:
    """(capture, stretch_lo, stretch_hi, stretch_share): log stretch of mean T over the pixels that hardly
    clip, if there are ``least`` of them, else over all that have a mean."""
    seen = pixels.where(~F.isnan("band_mean")).select(
        "capture", F.log10(F.greatest("band_mean", F.lit(PREVIEW_FLOOR))).alias("v"), (F.col("clip_frac") <= PREVIEW_CLIP_SHARE).alias("clean")
    )
    sizes = seen.groupBy("capture").agg(F.count_if("clean").alias("n_clean"))
    every = pixels.groupBy("capture").agg(F.count(F.lit(1)).alias("n_pixels"))
    pop = seen.join(F.broadcast(sizes), "capture").where(F.col("clean") | (F.col("n_clean") < least))
    cuts = exact_percentiles(pop, ["capture"], "v", {"lo": PREVIEW_LO, "hi": PREVIEW_HI})
    hi = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))
    return cuts.join(every, "capture").select("capture", F.pow(F.lit(10.0), "lo").alias("stretch_lo"), F.pow(F.lit(10.0), hi).alias("stretch_hi"), (F.col("n") / F.col("n_pixels")).alias("stretch_share"))


def rescaled(cube: DataFrame, dims: DataFrame, keys: list[str], means: list[str], sets: list[str], size: int) -> DataFrame:
    """The scan axis by each capture's factor; captures that keep their length are left in place."""
    turned = dims.where("factor <> 1")
    weights = R.axis_weights_by(turned, "capture")
    moved = R.resample_axis_by(cube.where("factor <> 1"), "line", "capture", ["row", *keys], means, sets, size, weights)
    wanted = ["capture", "row", "line", *keys, *means, *sets]
    return cube.where("factor = 1").select(*wanted).unionByName(moved.select(*wanted))


def correct_transmittance(
    cube: DataFrame, captures: DataFrame, bundle: DataFrame, cells: DataFrame, size: int,
    full_scale: float = R.FULL_SCALE, min_rows: int = R.OPEN_BEAM_MIN_ROWS, least_clean: int = PREVIEW_LEAST_CLEAN,
) -> Corrected:
    """T = (raw - dark) / white * k, isolated bad cells filled, the scan axis rescaled.

    ``cube`` (capture, row, line, c[]); ``captures`` (capture, day, factor); ``bundle`` and ``cells``
    from ``operators.calibration``.  Negatives are kept; invalid cells and dropped bands are NaN.
    Captures of days with a problem in the bundle are left out of the cube; their quality row has it.
    The cube has t[], sat[] and, line by line, n_good, n_above, t_min, t_max, band_mean, clip_frac.
    """
    # Sensor-sized tables are written, so that Spark knows their size: joined by shuffle on the few captures
    # or sensor rows, a whole capture would be one task.
    sources = written(R.fill_sources(cells, "row", keys=["set"]), "sources")
    frames = written(C.set_frames(cells, sources, "row"), "frames")
    about = F.broadcast(settle(captures.join(bundle.where("problem IS NULL").select("day", "set", "k"), "day").select("capture", "set", "k", "factor")))  # a row a capture
    lit = cube.join(about, "capture").join(frames, ["set", "row"])
    unmasked = lambda x, i: (x.cast("double") - F.get("dark", i)) / F.get("white", i) * F.col("k")
    lit = lit.withColumn("t", F.transform("c", lambda x, i: F.when(F.get("valid", i), unmasked(x, i)).otherwise(F.lit(NAN))))
    lit = lit.withColumn("sat", F.transform("c", lambda x: x >= full_scale))

    # filled cells: one number per source travels, and only lines that have such cells are joined
    spots = sources.select("set", F.col("row").alias("to"), "band", F.col("src_row").alias("row"), "src_band")
    values = lit.select("capture", "set", "row", "line", "t").join(spots, ["set", "row"])
    means = values.groupBy("capture", "to", "line", "band").agg(F.avg(F.get("t", F.col("src_band"))).alias("x"))
    fixes = means.groupBy("capture", F.col("to").alias("row"), "line").agg(F.map_from_entries(F.collect_list(F.struct("band", "x"))).alias("fix"))
    keep = ["capture", "row", "line", "set", "factor", "t", "sat"]
    patched = lit.where("__filled").join(fixes, ["capture", "row", "line"], "left").withColumn(
        "t", F.transform("t", lambda x, i: F.coalesce(F.try_element_at(F.col("fix"), i), x))
    )
    filled = lit.where("NOT __filled").select(*keep).unionByName(patched.select(*keep))

    dims = cube.groupBy("capture").agg((F.max("line") + 1).alias("n")).join(about, "capture")
    scaled = rescaled(filled, dims, ["set"], ["t"], ["sat"], size)
    told = scaled.join(frames.select("set", "row", "valid", "kept"), ["set", "row"])
    good = F.filter(F.transform("t", lambda x, i: F.when(F.get("valid", i) & ~F.get("sat", i) & ~F.isnan(x), x)), lambda x: x.isNotNull())
    clear = F.size(F.filter(F.zip_with("valid", "sat", lambda v, s: v & ~s), lambda b: b)).cast("long")
    told = R.band_mean(told.withColumns({"good": good, "n_clear": clear}), "t", "kept", "sat").withColumns(
        {"n_good": F.size("good").cast("long"), "n_above": count_in("good", lambda x: x > 1), "t_min": F.array_min("good"), "t_max": F.array_max("good")}
    )
    told = written(told.drop("valid", "kept"), "transmittance")
    out = told.drop("good")

    spread = bracketed_percentiles(told.select("capture", F.explode("good").alias("x")), ["capture"], "x", {"p1": 0.01, "median": 0.5, "p99": 0.99}).drop("n")
    in_range = F.avg(F.when(~F.isnan("band_mean"), (F.col("clip_frac") == 0).cast("double")))
    figures = out.groupBy("capture").agg(
        F.countDistinct("line").alias("lines_out"), (F.sum("n_clear") / F.sum(F.size("t"))).alias("valid_unsaturated_frac"),
        F.try_divide(F.sum("n_above"), F.sum("n_good")).alias("above_one"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"),
        F.coalesce(in_range, F.lit(0.0)).alias("fully_in_range_frac"),
    ).withColumn("unphysical", F.coalesce(F.col("above_one") > R.UNPHYSICAL_SHARE, F.lit(False)))
    beam_rows = cells.groupBy("set", "band").agg(F.count_if("cell_valid").alias("valid_rows"))
    raw = lit.select("capture", "set", "k", F.col("c").cast("array<double>").alias("c"), "dark", "white", F.col("cell_valid").alias("ok"))
    quality = captures.select("capture", "day").join(bundle.select("day", "set", "k", "exposures_differ", "problem"), "day", "left")
    for part in (raw_figures(cube, "c", full_scale), figures, spread, open_beam_by_capture(raw, beam_rows, full_scale, min_rows), stretch_of_clean(out, least_clean)):
        quality = quality.join(part, "capture", "left")
    return Corrected(out, quality.join(C.set_summary(cells, sources, "row"), "set", "left").drop("set"))


def tape_levels(darksub: DataFrame, tape: DataFrame, pct: float, coverage: float) -> tuple[DataFrame, DataFrame]:
    """White per (capture, row, band) on trusted rows, and the rows (capture, row, trusted).

    A row is trusted at ``coverage`` times the capture's median count of covered rows; if no row is,
    every covered row is.
    """
    counts = tape.groupBy("capture", "row").agg(F.count(F.lit(1)).alias("k"))
    limits = counts.groupBy("capture").agg((F.percentile("k", 0.5) * coverage).alias("limit"))  # one count a sensor row
    rows = counts.join(limits, "capture").withColumn("enough", F.col("k") >= F.col("limit"))
    none = rows.groupBy("capture").agg((~F.bool_or("enough")).alias("none"))
    rows = rows.join(none, "capture").select("capture", "row", (F.col("enough") | F.col("none")).alias("trusted"))
    on_tape = darksub.join(tape, ["capture", "row", "line"], "left_semi").join(rows.where("trusted"), ["capture", "row"], "left_semi")
    # whole counts: a cell has at most as many values as the sensor has levels
    known = level_percentile(R.long_bands(on_tape, "c", "capture", "row"), ["capture", "row", "band"], "x", pct, "white")
    return known, rows


def correct_reflectance(
    cube: DataFrame, captures: DataFrame, bundle: DataFrame, dark_frames: DataFrame, tape: DataFrame, size: int,
    pct: float = R.TAPE_PCT, coverage: float = R.TAPE_COVERAGE, full_scale: float = R.FULL_SCALE,
) -> Corrected:
    """Dark-subtracted counts over the tape's white, cropped to the tape's lines, rescaled.

    ``dark_frames`` (folder, row, dark[]) are means over lines; ``tape`` lists (capture, row, line) on
    the tape.  Rows without trusted tape take the white of their neighbours, linear between rows.  A
    capture without any tape is neither cropped nor normalised.  Lines count from the first kept.
    """
    about = F.broadcast(captures.join(bundle.where("problem IS NULL").select("day", F.col("dark").alias("folder")), "day").select("capture", "folder", "factor"))  # a row a capture
    lit = cube.join(about, "capture").join(dark_frames, ["folder", "row"])
    below = F.size(F.filter(F.transform("c", lambda x, i: x.cast("double") < F.get("dark", i)), lambda b: b)).cast("long")
    counts = F.transform("c", lambda x, i: F.floor(F.greatest(x.cast("double") - F.get("dark", i), F.lit(0.0))).cast("double"))
    darksub = lit.select("capture", "row", "line", "factor", below.alias("n_below"), counts.alias("c"))
    spots = tape.select("capture", "row", "line").distinct()
    span = spots.groupBy("capture").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("tape_pixels"))
    crop = darksub.join(F.broadcast(span.select("capture", "first_line", "last_line")), "capture", "left")
    crop = crop.where(F.col("first_line").isNull() | F.col("line").between(F.col("first_line"), F.col("last_line")))

    known, rows = tape_levels(darksub, spots, pct, coverage)
    spine = darksub.select("capture", "row").distinct()
    bands = spine.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("band"))
    white = clamp_interpolate(bands, known, ["capture", "band"], "row", "white")
    white = written(R.to_frame(white.withColumn("white", F.coalesce("white", F.lit(1.0))), ["capture", "row"], "white", "white"), "white")
    done = crop.join(white, ["capture", "row"]).select(
        "capture", "row", (F.col("line") - F.coalesce("first_line", F.lit(0))).alias("line"), "factor",
        F.transform("c", lambda x, i: F.coalesce(F.try_divide(x, F.get("white", i)), F.lit(NAN))).alias("r"),
    )
    before = done.groupBy("capture").agg(
        F.min(F.array_min(F.filter("r", lambda x: ~F.isnan(x)))).alias("r_min"), F.max(F.array_max(F.filter("r", lambda x: ~F.isnan(x)))).alias("r_max"),
        (F.sum(total(F.filter("r", lambda x: ~F.isnan(x)))) / F.sum(count_in("r", lambda x: ~F.isnan(x)))).alias("r_mean"), F.countDistinct("line").alias("lines_kept"),
    )
    dims = done.groupBy("capture").agg((F.max("line") + 1).alias("n")).join(about, "capture")
    out = written(R.band_mean(rescaled(done, dims, [], ["r"], [], size), "r"), "reflectance")
    stretch = exact_percentiles(out, ["capture"], "band_mean", {"stretch_lo": INTENSITY_LO, "stretch_hi": INTENSITY_HI}).drop("n")
    clipped = darksub.groupBy("capture").agg(F.sum("n_below").alias("n_below_dark"))
    trusted = rows.groupBy("capture").agg(F.count_if("trusted").alias("trusted_rows"))
    trusted = spine.groupBy("capture").agg(F.count(F.lit(1)).alias("rows")).join(trusted, "capture", "left").select(
        "capture", F.coalesce("trusted_rows", F.lit(0)).alias("trusted_rows"), (F.col("rows") - F.coalesce("trusted_rows", F.lit(0))).alias("interpolated_rows")
    )
    quality = captures.select("capture", "day").join(bundle.select("day", "problem"), "day", "left")
    for part in (raw_figures(cube, "c", full_scale), clipped, span, trusted, before, stretch):
        quality = quality.join(part, "capture", "left")
    return Corrected(out, quality)


def write_cube(corrected: Corrected, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Writes the cube by capture, replacing only captures it holds; the run's totals come from the same pass."""
    seen = Observation("corrected")
    vector = "t" if "t" in corrected.cube.columns else "r"
    watched = corrected.cube.observe(seen, F.count(F.lit(1)).alias("pixels"), F.sum(count_in(vector, lambda x: F.isnan(x))).alias("invalid_cells"))
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture").parquet(path)
    return corrected.cube.sparkSession.read.parquet(path), seen.get
