"""The dataset build over the order table read as captures.

720 orders make a capture of 20 sensor rows and 36 lines with six wells in two rows of three; prices
give absorbances in steps of 1/32, which half precision holds exactly. The last capture breaks off.
"""

from pyspark.sql import functions as F

from ..operators.patches import FLOOR
from . import build as V
from .registry import query, r6

ROWS, LINES, CELL_ROWS, CELL_LINES = 20, 36, 10, 12
SETTINGS = V.Settings(bands=3, erode_px=1, height=CELL_LINES, width=CELL_ROWS, scale=1.0)


def cube(t):
    o = F.col("o_orderkey")
    step = lambda b: (F.floor("o_totalprice") + 37 * b) % 120
    x = lambda b: F.when(step(b) >= 110, F.lit(1e-5)).otherwise(F.pow(F.lit(10.0), -step(b) / 32)).cast("float")
    sat = lambda b: step(b) % 17 == 0
    return t.orders.select(
        F.concat(F.lit("cap"), F.expr(f"o_orderkey div {ROWS * LINES}")).alias("capture"), (o % ROWS).cast("int").alias("row"),
        F.expr(f"o_orderkey div {ROWS} % {LINES}").cast("int").alias("line"), F.array(*map(x, range(3))).alias("bands"), F.array(*map(sat, range(3))).alias("sat"),
    )


def tables(t):
    """(captures, cells, masks): a mask is a box in each well, as high as the capture's items say."""
    n = ROWS * LINES
    captures = t.orders.groupBy(F.expr(f"o_orderkey div {n}").alias("k")).agg((F.max("o_custkey") % 4 + 4).alias("tall")).select(
        F.concat(F.lit("cap"), F.col("k")).alias("capture"), F.lit(ROWS).cast("bigint").alias("h"), F.lit(LINES).cast("bigint").alias("w"),
        F.lit("pass").alias("status"), "k", "tall",
    )
    at = captures.select("capture", "k", "tall", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s")).withColumns(
        {"a": F.expr("s div 3"), "b": F.col("s") % 3})
    x0, y0 = (ROWS - CELL_ROWS * (F.col("a") + 1)).cast("double"), (CELL_LINES * F.col("b")).cast("double")
    x1, y1 = x0 + CELL_ROWS, y0 + CELL_LINES
    cells = at.select(
        "capture", F.concat(F.lit("R"), "a", F.lit("C"), "b").alias("name"), F.col("s").alias("index"), F.lit("kernel").alias("kind"), F.col("s").alias("ord"),
        F.array((x0 + x1) / 2, (y0 + y1) / 2).alias("center"), F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)).alias("corners"),
    )
    first = (CELL_LINES * F.col("b") + 2) * ROWS + CELL_ROWS * F.col("a") + 2
    tall = F.col("tall")
    runs = F.concat(F.array(first), F.flatten(F.array_repeat(F.array(tall, ROWS - tall), 7)), F.array(tall, ROWS * LINES - first - 7 * ROWS - tall))
    masks = at.select("capture", (F.col("k") * 6 + F.col("s")).alias("ann_id"), F.lit(ROWS).cast("bigint").alias("h"), F.lit(LINES).cast("bigint").alias("w"), runs.alias("counts"))
    return captures.drop("k", "tall"), cells, masks


@query(
    "build_views",
    f"""WITH px AS (SELECT o_orderkey // 720 AS k, o_orderkey % 20 AS row, o_orderkey // 20 % 36 AS line, o_totalprice FROM orders),
long AS (SELECT k, row, line, b, CAST(floor(o_totalprice) + 37 * b AS BIGINT) % 120 AS p FROM px, (VALUES (0), (1), (2)) v(b)),
val AS (SELECT *, p % 17 = 0 AS sat, CASE WHEN p >= 110 THEN -log10({FLOOR}) ELSE p / 32.0::DOUBLE END AS q FROM long),
caps AS (SELECT o_orderkey // 720 AS k, max(o_custkey) % 4 + 4 AS tall FROM orders GROUP BY 1),
cell AS (SELECT k, tall, s, s // 3 AS a, s % 3 AS b3 FROM caps, (VALUES (0), (1), (2), (3), (4), (5)) v(s)),
box AS (SELECT c.k, c.s, avg(sat::INT::DOUBLE) AS sat_frac, coalesce(count(*) FILTER (NOT sat AND p >= 110)::DOUBLE / nullif(count(*) FILTER (NOT sat), 0), 0.0) AS clipped_frac
  FROM cell c JOIN val v ON v.k = c.k AND 19 - row >= 10 - 10 * a - 2 AND 19 - row < 20 - 10 * a + 2 AND line >= 12 * b3 - 2 AND line < 12 * b3 + 14 GROUP BY c.k, c.s),
patch AS (SELECT c.k, c.s, v.b, v.q, v.sat, row BETWEEN 10 * a + 3 AND 10 * a + tall AND line BETWEEN 12 * b3 + 3 AND 12 * b3 + 8 AS inside
  FROM cell c JOIN val v ON v.k = c.k AND row // 10 = a AND line // 12 = b3),
told AS (SELECT k, s, 1 - count(*) FILTER (NOT sat) / 360.0::DOUBLE AS nan_frac, count(*) FILTER (inside AND b = 0) AS patch_mask_px,
  avg(q) FILTER (inside AND NOT sat AND b = 0) AS s0, avg(q) FILTER (inside AND NOT sat AND b = 1) AS s1, avg(q) FILTER (inside AND NOT sat AND b = 2) AS s2 FROM patch GROUP BY k, s)
SELECT 'cap' || k AS capture, k * 6 + s AS ann_id, 'R' || a || 'C' || b3 AS cell, s AS cell_index, 1.0::DOUBLE AS containment, 6 * (tall - 2) AS mask_px, 8 * tall AS mask_px_raw,
  1::BIGINT AS n_components, 0::BIGINT AS dropped_px, round(sat_frac, 6) AS sat_frac, round(clipped_frac, 6) AS clipped_frac, round(coalesce(nan_frac, 1.0), 6) AS nan_frac,
  coalesce(patch_mask_px, 0) AS patch_mask_px, round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2
FROM cell JOIN box USING (k, s) LEFT JOIN told USING (k, s)""",
)
def build_views(t):
    """Every view of every capture with its counts and spectrum: pass one, patches, index."""
    planned = V.plan_views(*tables(t), SETTINGS)
    index = V.index_views(V.cut_views(cube(t), planned, SETTINGS), planned, SETTINGS)
    bands = [F.when(~F.isnan(F.get("spectrum", F.lit(b))), F.round(F.get("spectrum", F.lit(b)), 4) + 0.0).alias(f"s{b}") for b in range(3)]
    return index.select(
        "capture", "ann_id", "cell", "cell_index", "containment", "mask_px", "mask_px_raw", "n_components", "dropped_px",
        r6("sat_frac").alias("sat_frac"), r6("clipped_frac").alias("clipped_frac"), r6("nan_frac").alias("nan_frac"), "patch_mask_px", *bands,
    )
