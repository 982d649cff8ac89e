"""Boards read from customers, and the embedding table read as the pixels of patches."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import corners as C
from ..operators import patches as X
from .registry import query, r6

COLUMNS, BOARD = 7, 35
CELL = (1.0, 1.25)
FIGURES = ["px_scan", "px_spatial", "step_scan", "step_spatial", "theta_deg", "skew_deg", "rms_px", "max_px", "centre_x", "centre_y"]


@query(
    "corner_lattice",
    f"""WITH p AS (SELECT c_custkey // {BOARD} AS board, c_custkey % {BOARD} % {COLUMNS} AS i, c_custkey % {BOARD} // {COLUMNS} AS j, (c_custkey // {BOARD}) * 0.7 AS a, c_acctbal::DOUBLE AS e FROM customer),
xy AS (SELECT board, i, j, 300 + 10 * (i * cos(a) - j * 1.25 * sin(a)) + e / 20000 AS x, 200 + 22 * (i * sin(a) + j * 1.25 * cos(a)) - e / 30000 AS y FROM p),
m AS (SELECT board, count(*) AS n_corners, avg(i) AS mi, avg(j) AS mj, avg(x) AS mx, avg(y) AS my, var_pop(i) AS ii, var_pop(j) AS jj, covar_pop(i, j) AS ij,
  covar_pop(i, x) AS ix, covar_pop(j, x) AS jx, covar_pop(i, y) AS iy, covar_pop(j, y) AS jy FROM xy GROUP BY board),
d AS (SELECT *, CASE WHEN ii * jj - ij * ij > 1e-9 THEN ii * jj - ij * ij END AS det FROM m),
f AS (SELECT *, (ix * jj - jx * ij) / det AS xi, (jx * ii - ix * ij) / det AS xj, (iy * jj - jy * ij) / det AS yi, (jy * ii - iy * ij) / det AS yj FROM d),
off AS (SELECT board, max(sqrt(u * u + v * v)) AS max_px, sqrt(avg(u * u + v * v)) AS rms_px FROM (
  SELECT board, x - mx - xi * (i - mi) - xj * (j - mj) AS u, y - my - yi * (i - mi) - yj * (j - mj) AS v FROM xy JOIN f USING (board)) GROUP BY board),
s AS (SELECT *, abs(xj) > abs(xi) AS swap FROM f),
t AS (SELECT board, n_corners, mx, my, CASE WHEN swap THEN xj ELSE xi END AS x1, CASE WHEN swap THEN xi ELSE xj END AS x2, CASE WHEN swap THEN yj ELSE yi END AS y1, CASE WHEN swap THEN yi ELSE yj END AS y2 FROM s),
u AS (SELECT board, n_corners, mx, my, abs(x1) AS x1, CASE WHEN x1 < 0 THEN -x2 ELSE x2 END AS x2, CASE WHEN x1 < 0 THEN -y1 ELSE y1 END AS y1, CASE WHEN x1 < 0 THEN -y2 ELSE y2 END AS y2 FROM t),
w AS (SELECT *, sqrt(x1 * x1 + x2 * x2 / 1.5625) AS px_scan, sqrt(y1 * y1 + y2 * y2 / 1.5625) AS px_spatial FROM u)
SELECT board, n_corners, round(px_scan, 6) AS px_scan, round(px_spatial, 6) AS px_spatial, round(sqrt(x1 * x1 + x2 * x2), 6) AS step_scan, round(sqrt(y1 * y1 + y2 * y2), 6) AS step_spatial,
  round(degrees(atan2(y1, x1)), 6) + 0.0 AS theta_deg, round(degrees(asin(greatest(-1.0, least(1.0, (x1 * y1 + x2 * y2 / 1.5625) / (px_scan * px_spatial))))), 6) + 0.0 AS skew_deg,
  abs(abs(x2) - abs(x1)) < 0.1 * abs(x1) AS axis_ambiguous, round(rms_px, 6) AS rms_px, round(max_px, 6) AS max_px, round(mx, 6) AS centre_x, round(my, 6) AS centre_y
FROM w JOIN off USING (board)""",
)
def corner_lattice(t):
    """Boards at many angles, with jitter, the last one in part: scales, turn, skew and misses."""
    k, a, e = F.col("c_custkey"), F.col("board") * 0.7, F.col("c_acctbal").cast("double")
    placed = t.customer.withColumns({"board": F.expr(f"c_custkey div {BOARD}"), "n": k % BOARD})
    i, j = C.ideal_lattice(F.col("n"), COLUMNS)
    x = 300 + 10 * (i * F.cos(a) - j * 1.25 * F.sin(a)) + e / 20000
    y = 200 + 22 * (i * F.sin(a) + j * 1.25 * F.cos(a)) - e / 30000
    out = C.board_scales(placed.select("board", "n", x.alias("x"), y.alias("y")), ["board"], COLUMNS, CELL)
    return out.select(*[r6(c).alias(c) if c in FIGURES else F.col(c) for c in out.columns])


BANDS = 64
BASIS = np.cos(np.outer(np.arange(1, BANDS + 1), np.arange(1, 4)) * 0.1)
MEAN = np.arange(BANDS) * 0.01
#: the pixels: label is the view, some pixels miss a band, some lie outside the mask, view 7 has no mask
PIXELS = """long AS (SELECT vec_id, label, vec_id % 3 <> 0 AND label <> 7 AS inside, generate_subscripts(embedding, 1) - 1 AS b, unnest(embedding::DOUBLE[]) AS raw FROM embeddings),
px AS (SELECT vec_id, label, inside, b, CASE WHEN vec_id % 11 <> 0 OR b <> 3 THEN raw END AS x FROM long)"""


def pixels(t):
    lost = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 11 == 0) & (i == 3), F.lit(float("nan"))).otherwise(x.cast("double")))
    return t.embeddings.select("vec_id", "label", ((F.col("vec_id") % 3 != 0) & (F.col("label") != 7)).alias("inside"), lost.alias("bands"))


@query(
    "patch_scores",
    f"""WITH {PIXELS}, z AS (SELECT vec_id, b, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM px WHERE inside AND vec_id % 11 <> 0 WINDOW w AS (PARTITION BY vec_id)),
s AS (SELECT vec_id, {", ".join(f"sum((z - b * 0.01) * cos((b + 1) * {k} * 0.1)) AS pc{k}" for k in (1, 2, 3))} FROM z GROUP BY vec_id)
SELECT e.vec_id, e.label, {", ".join(f"round(pc{k}, 5) + 0.0 AS pc{k}" for k in (1, 2, 3))} FROM embeddings e LEFT JOIN s USING (vec_id)""",
)
def patch_scores(t):
    """Scores of every pixel; those outside or with a missing band have none."""
    out = X.patch_scores(pixels(t), "bands", MEAN, BASIS)
    return out.select("vec_id", "label", *[(F.round(F.get("scores", F.lit(k)), 5) + 0.0).alias(f"pc{k + 1}") for k in range(3)])


@query(
    "patch_image",
    f"""WITH {PIXELS}, g AS (SELECT vec_id, label, inside, avg(x) AS g, count(x) AS seen, count(*) AS n FROM px GROUP BY vec_id, label, inside),
v AS (SELECT label, coalesce(1 - sum(seen) FILTER (inside) / (sum(n) FILTER (inside))::DOUBLE, 1.0) AS invalid, bool_or(inside) AS has FROM g GROUP BY label),
e AS (SELECT label, quantile_cont(g, 0.02) AS lo, quantile_cont(g, 0.98) AS hi FROM g JOIN v USING (label) WHERE inside OR NOT has GROUP BY label),
r AS (SELECT *, hi - lo AS span, 0.15 * greatest(hi - lo, 1e-9) AS pad FROM e)
SELECT vec_id, label, round(invalid, 6) AS invalid, round(greatest(0.0, least(1.0, (g - lo + pad) / greatest(span + 2 * pad, 1e-9))), 6) AS shade FROM g JOIN v USING (label) JOIN r USING (label)""",
)
def patch_image(t):
    out = X.patch_image(pixels(t), ["label"], "bands")
    return out.select("vec_id", "label", r6("invalid").alias("invalid"), r6("shade").alias("shade"))
