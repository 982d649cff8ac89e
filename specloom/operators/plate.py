"""The fixed 4 x 7 plate: its cells, poses and affine frame, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The plate model.
N_ROWS, N_COLS = 4, 7
RIM_CORNERS = ((0, 0), (0, 6), (3, 0), (3, 6))
MARKER_CELL = {0: (3, 3), 1: (2, 6), 2: (2, 6), 3: (3, 3)}
SIDE_OF_MARKER = {0: "dorsal", 1: "dorsal", 2: "ventral", 3: "ventral"}
POSES = (("identity", False, False), ("flip_col", False, True), ("flip_row", True, False), ("rot180", True, True))
CELL_SCALE = 1.10
OCCUPANCY_INSET = 0.18


def cell_name(r: Column, c: Column) -> Column:
    return F.concat(F.lit("R"), r.cast("string"), F.lit("C"), c.cast("string"))


def cells(spark: SparkSession) -> DataFrame:
    """28 rows ``(row, col, kind, name, index)``; the index counts kernel wells row-major."""
    grid = spark.range(N_ROWS * N_COLS, numPartitions=1).select(
        F.floor(F.col("id") / N_COLS).cast("int").alias("row"), (F.col("id") % N_COLS).cast("int").alias("col")
    )

    def one_of(spots) -> Column:
        return F.struct("row", "col").isin(
            [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r, c in sorted(set(spots))]
        )

    kind = (
        F.when(one_of(RIM_CORNERS), "rim").when(one_of(MARKER_CELL.values()), "marker").otherwise("kernel")
    )
    wells = [(r, c) for r in range(N_ROWS) for c in range(N_COLS)]
    wells = [rc for rc in wells if rc not in RIM_CORNERS and rc not in MARKER_CELL.values()]
    number = F.create_map(*[x for i, (r, c) in enumerate(wells) for x in (F.lit(r * N_COLS + c), F.lit(i))])
    return grid.select(
        "row",
        "col",
        kind.alias("kind"),
        cell_name(F.col("row"), F.col("col")).alias("name"),
        F.when(kind == "kernel", F.try_element_at(number, F.col("row") * N_COLS + F.col("col"))).alias("index"),
    )


def pose_cell(flip_row: Column, flip_col: Column, j: Column, i: Column) -> tuple[Column, Column]:
    """Plate (row, col) of lattice index (j long axis, i short axis) under a pose."""
    return (
        F.when(flip_row, N_ROWS - 1 - j).otherwise(j).cast("int"),
        F.when(flip_col, N_COLS - 1 - i).otherwise(i).cast("int"),
    )


def wrong_poses(spark: SparkSession) -> DataFrame:
    """(pose, index, other): which well a wrong pose would report in place of ``index``.

    ``other`` is NULL where the relabelled spot is no kernel well.
    """
    wells = cells(spark).where("kind = 'kernel'").select("row", "col", "index")
    poses = F.array(
        *[
            F.struct(F.lit(n).alias("pose"), F.lit(fr).alias("fr"), F.lit(fc).alias("fc"))
            for n, fr, fc in POSES
            if n != "identity"
        ]
    )
    moved = wells.select("index", "row", "col", F.inline(poses))
    r, c = pose_cell(F.col("fr"), F.col("fc"), F.col("row"), F.col("col"))
    target = wells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("index").alias("other"))
    return moved.select("pose", "index", r.alias("r2"), c.alias("c2")).join(target, ["r2", "c2"], "left").select(
        "pose", "index", "other"
    )


def corner_point(origin: str, e_col: str, e_row: str, r: Column, c: Column) -> Column:
    """origin + c * e_col + r * e_row as a two-element array."""
    part = lambda k: (
        F.get(F.col(origin), F.lit(k)) + c * F.get(F.col(e_col), F.lit(k)) + r * F.get(F.col(e_row), F.lit(k))
    )
    return F.array(part(0), part(1))


def cells_from_frame(frames: DataFrame, keys: list[str]) -> DataFrame:
    """All 28 cells of every capture with centre and corners.

    Each capture explodes the same 28 grid spots, so nothing is cross-joined.
    """
    spots = F.array(
        *[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(N_ROWS) for c in range(N_COLS)]
    )
    out = frames.select(*keys, "origin", "e_col", "e_row", F.inline(spots))
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    at = lambda dr, dc: corner_point("origin", "e_col", "e_row", r + dr, c + dc)
    placed = out.select(
        *keys,
        "row",
        "col",
        at(0, 0).alias("center"),
        F.array(at(-0.5, -0.5), at(-0.5, 0.5), at(0.5, 0.5), at(0.5, -0.5)).alias("corners"),
    )
    return placed.join(F.broadcast(cells(frames.sparkSession)), ["row", "col"])


def tag_markers(placed: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Record which fiducial id was read in each marker cell; ``seen`` holds (keys, marker_id)."""
    spot = F.create_map(*[x for m, (r, c) in MARKER_CELL.items() for x in (F.lit(m), F.lit(r * N_COLS + c))])
    ids = seen.select(*keys, "marker_id", F.try_element_at(spot, F.col("marker_id")).alias("__spot"))
    ids = ids.where("__spot IS NOT NULL").groupBy(*keys, "__spot").agg(F.max("marker_id").alias("marker_id"))
    return placed.withColumn("__spot", F.col("row") * N_COLS + F.col("col")).join(ids, [*keys, "__spot"], "left").drop(
        "__spot"
    )


def side_from_ids(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The side its fiducial ids agree on, or NULL when they do not."""
    side = F.create_map(*[x for m, s in SIDE_OF_MARKER.items() for x in (F.lit(m), F.lit(s))])
    sides = seen.withColumn("__s", F.try_element_at(side, F.col("marker_id"))).groupBy(*keys).agg(
        F.min("__s").alias("lo"), F.max("__s").alias("hi"), F.count_distinct("marker_id").alias("ids")
    )
    return sides.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("side_observed"), "ids")


def quad(corners: Column, center: Column, scale: float = CELL_SCALE) -> Column:
    """Corners moved away from the centre by ``scale``."""
    move = lambda p, k: F.get(center, F.lit(k)) + (F.get(p, F.lit(k)) - F.get(center, F.lit(k))) * scale
    return F.transform(corners, lambda p: F.array(move(p, 0), move(p, 1)))


def bbox(corners: Column, width: Column, lines: Column, pad: int = 2, least: int = 8) -> Column:
    """Clamped (x0, x1, y0, y1) around the corners; NULL when under ``least`` pixels."""
    xs = F.transform(corners, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(corners, lambda p: F.get(p, F.lit(1)))
    x0 = F.greatest(F.floor(F.array_min(xs)) - pad, F.lit(0)).cast("int")
    y0 = F.greatest(F.floor(F.array_min(ys)) - pad, F.lit(0)).cast("int")
    x1 = F.least(F.ceil(F.array_max(xs)) + pad, width).cast("int")
    y1 = F.least(F.ceil(F.array_max(ys)) + pad, lines).cast("int")
    box = F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), box)
