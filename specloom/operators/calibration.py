"""Calibration inputs of many days at once: which captures each day uses, and what they measure.

A catalog lists calibration captures (kind, day, folder); a NULL day is shared by all days and a
day's own capture takes its place.  Days that use the same captures share one calibration set, so
frames are collapsed once a capture and judged once a set, however many days or dishes there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exposure_us
from . import radiometry as R
from .ordered import level_percentile

TRANSMITTANCE_KINDS = ("dark_sample", "dark_white", "white")
REFLECTANCE_KINDS = ("dark",)


def resolve(catalog: DataFrame, days: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(day, kind, folder, scope, ambiguous) for every day and kind; folder is NULL if there is none."""
    wanted = days.select("day").distinct().select("day", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    found = F.struct(F.min("folder").alias("folder"), F.count_distinct("folder").alias("n"))
    own = catalog.where("day IS NOT NULL").groupBy("day", "kind").agg(found.alias("own"))
    shared = catalog.where("day IS NULL").groupBy("kind").agg(found.alias("shared"))
    pick = F.coalesce("own", "shared")
    scope = F.when(F.col("own").isNotNull(), "day-specific").when(F.col("shared").isNotNull(), "shared")
    out = wanted.join(own, ["day", "kind"], "left").join(shared, "kind", "left")
    return out.select("day", "kind", pick["folder"].alias("folder"), scope.alias("scope"), (pick["n"] > 1).alias("ambiguous"))


def _per_day(resolved: DataFrame, kinds: Sequence[str]) -> DataFrame:
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = [of(k, c).alias(k if c == "folder" else f"{k}_{c}") for k in kinds for c in ("folder", "scope")]
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("folder").isNull(), F.col("kind")))), ", ")
    doubled = F.array_join(F.array_sort(F.collect_list(F.when(F.col("ambiguous"), F.col("kind")))), ", ")
    return resolved.groupBy("day").agg(*wide, missing.alias("__missing"), doubled.alias("__doubled"))


def _inputs_problem() -> Column:
    return F.when(F.col("__missing") != "", F.concat(F.lit("no "), F.col("__missing"))).when(
        F.col("__doubled") != "", F.concat(F.lit("more than one "), F.col("__doubled"))
    )


def last_name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def transmittance_bundle(
    catalog: DataFrame, days: DataFrame, sample_us: float | None = None, white_us: float | None = None
) -> DataFrame:
    """One row per day: the three captures and their scopes, exposures, k, and what is wrong.

    Exposures come from the folder names unless given.  k = t_short / t_long.  ``exposures_differ``
    says that the white's dark was taken at another exposure than the white.  ``set`` names the three
    captures; ``problem`` is NULL where the day can be corrected, and without k where it is not.
    """
    one = _per_day(resolve(catalog, days, TRANSMITTANCE_KINDS), TRANSMITTANCE_KINDS)
    given = lambda us, folder: F.lit(float(us)) if us is not None else exposure_us(last_name(folder)).cast("double")
    one = one.withColumn("t_long", given(sample_us, "dark_sample")).withColumn("t_short", given(white_us, "white"))
    dark_us = exposure_us(last_name("dark_white")).cast("double")
    unreadable = F.when(F.col("t_long").isNull(), "no exposure in dark_sample").when(F.col("t_short").isNull(), "no exposure in white")
    one = one.withColumn("problem", F.coalesce(_inputs_problem(), unreadable))
    sound = lambda c: F.when(F.col("problem").isNull(), c)
    return one.select(
        "day", *TRANSMITTANCE_KINDS, *[f"{k}_scope" for k in TRANSMITTANCE_KINDS], "t_long", "t_short",
        sound(F.try_divide("t_short", "t_long")).alias("k"),
        sound(F.coalesce(F.abs(dark_us - F.col("t_short")) > 1e-6, F.lit(False))).alias("exposures_differ"),
        F.concat_ws("|", *TRANSMITTANCE_KINDS).alias("set"), "problem",
    )


def reflectance_bundle(catalog: DataFrame, days: DataFrame) -> DataFrame:
    one = _per_day(resolve(catalog, days, REFLECTANCE_KINDS), REFLECTANCE_KINDS)
    return one.select("day", "dark", "dark_scope", _inputs_problem().alias("problem"))


def median_frames(lines: DataFrame, row: str, vector: str) -> DataFrame:
    """(folder, row, frame[]): medians over the lines that are not blank, all captures at once.

    Counts of a sensor cell take at most as many values as the sensor has levels, so they are counted
    by level first.
    """
    cells = R.long_bands(lines.where(~R.is_blank(vector)), vector, "folder", row)
    return R.to_frame(level_percentile(cells, ["folder", row, "band"], "x", 0.5, "m"), ["folder", row], "m", "frame")


def reference_cells(
    lines: DataFrame, bundle: DataFrame, row: str, vector: str,
    keep_share: float = R.BAND_KEEP_SHARE, hot_factor: float = R.HOT_FACTOR,
) -> DataFrame:
    """(set, row, band, dark, w, hot, cell_valid, valid, band_level, band_kept) of every usable set.

    ``lines`` holds raw calibration lines (folder, row, vector).  ``dark`` is the sample's dark and
    ``w`` the white less its own dark, both medians over lines that are not blank.  A cell is valid at
    >= 100 counts, >= 0.15 of its band's typical row, and not hot; a band is kept at ``keep_share`` of
    the set's brightest band.  All medians run over the sensor cells of one set, a bounded number.
    """
    frames = median_frames(lines, row, vector)
    sets = bundle.where("problem IS NULL").select("set", *TRANSMITTANCE_KINDS).distinct()
    of = lambda kind, name: frames.select(F.col("folder").alias(kind), row, F.col("frame").alias(name))
    three = sets.join(of("dark_sample", "d"), "dark_sample").join(of("dark_white", "s"), ["dark_white", row]).join(of("white", "w"), ["white", row])
    zipped = F.arrays_zip(F.col("d"), F.zip_with("w", "s", lambda w, s: w - s).alias("w"))
    cells = three.select("set", row, F.posexplode(zipped).alias("band", "z")).select("set", row, "band", F.col("z")["d"].alias("dark"), F.col("z")["w"].alias("w"))
    limits = cells.groupBy("set").agg((F.percentile("dark", 0.5) * hot_factor).alias("__limit"))
    typical = cells.groupBy("set", "band").agg(F.percentile("w", 0.5).alias("__typical"))
    judged = cells.join(limits, "set").join(typical, ["set", "band"]).withColumn("hot", F.col("dark") > F.col("__limit"))
    judged = judged.withColumn(
        "cell_valid", (F.col("w") >= R.MIN_WHITE_COUNTS) & (F.col("w") >= R.MIN_WHITE_SHARE * F.col("__typical")) & ~F.col("hot")
    )
    levels = judged.groupBy("set", "band").agg(
        F.coalesce(F.percentile(F.when(F.col("cell_valid"), F.col("w")), 0.5), F.lit(0.0)).alias("band_level")
    )
    peaks = levels.groupBy("set").agg(F.max("band_level").alias("__peak"))
    bands = levels.join(peaks, "set").select("set", "band", "band_level", (F.col("band_level") >= keep_share * F.col("__peak")).alias("band_kept"))
    return judged.join(bands, ["set", "band"]).select(
        "set", row, "band", "dark", "w", "hot", "cell_valid", (F.col("cell_valid") & F.col("band_kept")).alias("valid"), "band_level", "band_kept"
    )


def set_frames(cells: DataFrame, sources: DataFrame, row: str) -> DataFrame:
    """One row per (set, row): arrays dark, white, valid, cell_valid, kept, and whether cells are filled."""
    names = ("dark", "white", "valid", "cell_valid", "kept")
    cell = F.struct("band", "dark", F.col("w").alias("white"), "valid", "cell_valid", F.col("band_kept").alias("kept"))
    got = cells.groupBy("set", row).agg(F.array_sort(F.collect_list(cell)).alias("c"))  # one entry a band
    arrays = got.select("set", row, *[F.transform("c", R._field(n)).alias(n) for n in names])
    filled = sources.select("set", row).distinct().withColumn("__filled", F.lit(True))
    return arrays.join(filled, ["set", row], "left").withColumn("__filled", F.coalesce("__filled", F.lit(False)))


def set_summary(cells: DataFrame, sources: DataFrame, row: str) -> DataFrame:
    """Bands kept, invalid share, hot cells and filled cells of every set."""
    counts = cells.groupBy("set").agg(
        F.count_distinct(F.when(F.col("band_kept"), F.col("band"))).alias("bands_kept"),
        F.avg((~F.col("valid")).cast("double")).alias("invalid_frac"), F.count_if("hot").alias("hot_cells"),
    )
    filled = sources.select("set", row, "band").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("filled_cells"))
    return counts.join(filled, "set", "left").withColumn("filled_cells", F.coalesce("filled_cells", F.lit(0)))
