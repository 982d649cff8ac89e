"""The dataset of kernel views, built capture by capture and rebuilt only where something changed.

A capture's key covers its fingerprint, its cells, its masks and the settings.  Captures whose key
the last build already has keep the files of the run that made them; the others are cut anew into a
run of their own.  The manifest (capture, key, run, n_views) is written last and names the files that
count: a build that breaks off leaves the former dataset as it was, captures that are gone leave the
manifest, and a build that runs again writes its own run over.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as K
from ..operators import ordered
from ..operators import patches as X
from ..operators import plate as P
from ..operators.collapse import mean_vector_skipnan
from ..session import settle, written

# Problems that forbid a build.
FATAL = [
    "SHAPE_MISMATCH", "FIT_FAILED", "MASK_OFF_LATTICE", "MASK_STRADDLES_CELLS", "TWO_MASKS_ONE_CELL", "EMPTY_MASK", "MASK_ERODED_AWAY",
]


@dataclass(frozen=True)
class Settings:
    """What a view depends on besides its inputs; ``bands`` is the length of the arrays kept."""

    bands: int
    erode_px: int
    height: int = X.PATCH_H
    width: int = X.PATCH_W
    scale: float = P.CELL_SCALE


@dataclass
class Planned:
    rows: DataFrame
    segments: DataFrame
    problems: DataFrame


def plan_views(captures: DataFrame, cells: DataFrame, masks: DataFrame, settings: Settings) -> Planned:
    """Which mask belongs to which well of which capture, before any pixel is read.

    ``captures`` (capture, h sensor rows, w lines, status); ``cells`` (capture, name, index, kind, ord,
    center[], corners[][]) with corners in the working frame; ``masks`` (capture, ann_id, h, w, counts[])
    in the cube's layout, in which wells are rasterised as well.
    """
    keys = ["capture", "ann_id"]
    # One row a mask, its segments as arrays.
    prepared = settle(K.prepare_gathered(K.gather_rle(masks, keys, "counts"), keys, settings.erode_px, masks))
    segments, counted = K.spread(prepared, keys), prepared.select(*keys, "n_components", "dropped_px", "raw_px")
    drawn = masks.join(counted, keys, "left").select(*keys, "h", "w", F.coalesce("raw_px", F.lit(0)).alias("raw_px"))
    size = captures.select("capture", "h", "w")
    turned = F.transform("corners", lambda p: F.array(F.get(p, F.lit(1)), F.col("h") - 1 - F.get(p, F.lit(0))))
    label = F.when(F.col("kind") == "kernel", F.col("index") + 1).when(F.col("kind") == "marker", K.MARKER_LABEL).otherwise(K.RIM_LABEL)
    flat = cells.join(size, "capture").select("capture", turned.alias("corners"), label.alias("label"), "ord", "h", "w")
    labels = K.cell_labels(K.quad_segments(flat, ["capture"], "h", "w"), ["capture"], "label", "ord")
    kernels = cells.where("kind = 'kernel'")
    wells = kernels.groupBy("capture").agg(F.array_sort(F.collect_set((F.col("index") + 1).cast("int"))).alias("wells"))
    fitted = captures.join(wells, "capture", "left").select("capture", "h", "w", "status", F.coalesce("wells", F.array().cast("array<int>")).alias("wells"))
    matched, problems = K.assign(drawn, segments, labels, fitted, ["capture"], "ann_id", "ann_id")
    spots = kernels.select("capture", F.col("index").alias("cell_index"), F.col("name").alias("cell"), P.quad(F.col("corners"), F.col("center"), settings.scale).alias("corners"))
    rows = matched.join(spots, ["capture", "cell_index"]).join(counted, keys).join(size, "capture").select(
        *keys, "cell", "cell_index", "containment", F.col("npx").alias("mask_px"), F.col("raw_px").alias("mask_px_raw"), "n_components", "dropped_px", "corners", "h", "w",
    )
    outside = P.bbox(F.col("corners"), F.col("h"), F.col("w")).isNull()
    rows = settle(rows.withColumn("__outside", outside))
    lost = rows.where("__outside").select(*keys, F.lit("CELL_OUTSIDE_FRAME").alias("problem"), (F.col("cell_index") + 1).cast("int").alias("label"))
    return Planned(rows.where("NOT __outside").drop("__outside"), segments, problems.unionByName(lost))


def cut_views(cube: DataFrame, planned: Planned, settings: Settings) -> DataFrame:
    """Patch pixels of all planned views, from ``cube`` (capture, row, line, bands[], sat[])."""
    boxes = planned.rows.select("capture", "ann_id", "corners", "h", "w")
    pixels = X.view_pixels(boxes, X.working_pixels(cube.join(planned.rows.select("capture", "h").distinct(), "capture"), F.col("h")), ["capture"], "ann_id", "h", "w")
    spans = planned.segments.groupBy("capture", "ann_id", F.col("c").alias("line")).agg(F.collect_list(F.struct("r0", "r1")).alias("__s"))
    inside = F.exists("__s", lambda s: F.col("row").between(s["r0"], s["r1"]))
    marked = pixels.join(spans, ["capture", "ann_id", "line"], "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    return X.cut_patches(marked, ["capture"], "ann_id", settings.height, settings.width)


def index_views(pixels: DataFrame, planned: Planned, settings: Settings) -> DataFrame:
    """One row per view: its place, its counts and its spectrum, taken from the patch as stored.

    One aggregate over the pixels, so that patches are not cut twice; a band without values is NaN.
    """
    keys = ["capture", "ann_id"]
    counts = ["sat_frac", "clipped_frac", "nan_frac", "patch_mask_px"]
    masked = pixels.withColumn("__inside", F.when(F.col("inside"), F.col("bands")))
    told = masked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in counts], mean_vector_skipnan("__inside", settings.bands).alias("spectrum"))
    return planned.rows.drop("corners", "h", "w").join(told, keys)


def content_keys(captures: DataFrame, cells: DataFrame, masks: DataFrame, settings: Settings) -> DataFrame:
    """(capture, key) of every capture; equal inputs in any order give equal keys."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(*sorted(c for c in df.columns if c != "capture")), {"ignoreNullFields": "false"})
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
        return df.groupBy("capture").agg(F.struct(F.count(F.lit(1)), total(0), total(1)).alias(name))

    every = captures.select("capture", F.to_json(F.struct(*sorted(captures.columns)), {"ignoreNullFields": "false"}).alias("c"))
    both = every.join(digest(cells, "k"), "capture", "left").join(digest(masks, "m"), "capture", "left")
    return both.select("capture", F.sha2(F.concat_ws("|", F.lit(repr(sorted(asdict(settings).items()))), "c", F.to_json(F.struct("k", "m"))), 256).alias("key"))


def manifest(spark: SparkSession, out: str) -> DataFrame | None:
    """The captures of the newest finished build, or None before the first."""
    try:
        every = spark.read.parquet(f"{out}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return every.where(F.col("build") == every.agg(F.max("build")).scalar())


def build_views(
    spark: SparkSession, out: str, captures: DataFrame, cells: DataFrame, masks: DataFrame, cube: DataFrame, settings: Settings
) -> DataFrame:
    """Bring the dataset below ``out`` up to date and return its manifest.

    ``captures`` also holds (mode, day, dish, side) and a ``fingerprint`` of the capture's cube; ``cube``
    should be partitioned by capture, so that only changed captures are read. A fatal problem of a changed
    capture fails the build before anything is written.
    """
    last = manifest(spark, out)
    number = 0 if last is None else last.agg(F.max("build")).first()[0] + 1
    keys = content_keys(captures, cells, masks, settings)
    told = F.lit("new")
    if last is not None:
        old = last.select("capture", F.col("key").alias("__old"), "run", "n_views")
        keys, told = keys.join(old, "capture", "left"), F.when(F.col("__old") == F.col("key"), "kept").when(F.col("__old").isNotNull(), "changed").otherwise("new")
    states = written(keys.withColumn("state", told), "states")
    todo = states.where("state <> 'kept'")
    of = lambda df: df.join(todo.select("capture"), "capture", "left_semi")
    changed = settle(of(captures))
    planned = plan_views(changed, of(cells), of(masks), settings)
    problems = settle(planned.problems)
    fatal = problems.where(F.col("problem").isin(FATAL)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("capture").alias("first")).collect()
    if fatal:
        raise ValueError("refusing to build: " + ", ".join(f"{r['problem']} x {r['n']} (first in {r['first']})" for r in sorted(fatal)))
    # By name, so that no plan reads other partitions; the driver lists the cube's capture folders in any case.
    pixels = cube if last is None else cube.where(F.col("capture").isin([r["capture"] for r in changed.select("capture").collect()]))
    of_run = lambda name: f"{out}/{name}/run={number}"
    cut_views(pixels, planned, settings).write.mode("overwrite").partitionBy("capture").parquet(of_run("patches"))
    index = index_views(spark.read.schema(PATCHES).parquet(of_run("patches")), planned, settings)
    index.join(changed.select("capture", "mode", "day", "dish", "side"), "capture").write.mode("overwrite").parquet(of_run("views"))
    problems.write.mode("overwrite").parquet(of_run("problems"))
    made = spark.read.parquet(of_run("views")).groupBy("capture").agg(F.count(F.lit(1)).alias("n_views"))
    whole = todo.select("capture", "key").join(made, "capture", "left").select("capture", "key", F.lit(number).alias("run"), F.coalesce("n_views", F.lit(0)).alias("n_views"))
    if last is not None:
        whole = whole.unionByName(states.where("state = 'kept'").select("capture", "key", "run", "n_views"))
    whole.write.mode("overwrite").parquet(f"{out}/manifest/build={number}")
    return manifest(spark, out)


PATCHES = (
    "capture string, ann_id bigint, py int, px int, inside boolean, bands array<float>, sat_frac double, clipped_frac double, "
    "nan_frac double, patch_mask_px int"
)


def read_built(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(views, patch pixels) of the newest build; ``row`` numbers the views 0..N-1 by mode, day, dish, side and well."""
    current = manifest(spark, out).select("capture", "run")
    views = spark.read.option("basePath", f"{out}/views").parquet(f"{out}/views").join(current, ["capture", "run"])
    place = (((F.col("mode") == "transmittance").cast("long") * 1_000_000 + F.col("day")) * 1_000_000 + F.col("dish")) * 2 + (F.col("side") == "ventral").cast("long")
    rows = ordered.position(views.withColumn("__place", place), [], "__place", "cell_index", "row").drop("__place")
    patches = spark.read.schema(f"{PATCHES}, run int").option("basePath", f"{out}/patches").parquet(f"{out}/patches")
    return rows, patches.join(current, ["capture", "run"])
