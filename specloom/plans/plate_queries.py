"""Plate geometry, pose search and cross-capture checks over customers and orders."""

from pyspark.sql import functions as F

from ..operators import consistency as C
from ..operators import lattice as L
from ..operators import plate as P
from .registry import query, r6, rounded

KERNEL = "((r IN (0, 3) AND c IN (0, 6)) OR (r = 3 AND c = 3) OR (r = 2 AND c = 6))"


@query(
    "plate_cells",
    f"""WITH g AS (SELECT n_nationkey, r, c FROM nation, (SELECT unnest(range(4)) AS r) a, (SELECT unnest(range(7)) AS c) b),
k AS (SELECT *, CASE WHEN r IN (0, 3) AND c IN (0, 6) THEN 'rim' WHEN {KERNEL} THEN 'marker' ELSE 'kernel' END AS kind FROM g)
SELECT n_nationkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, kind, 'R' || r || 'C' || c AS name,
  CAST(CASE WHEN kind = 'kernel' THEN sum((kind = 'kernel')::INT) OVER (PARTITION BY n_nationkey ORDER BY r, c ROWS UNBOUNDED PRECEDING) - 1 END AS INTEGER) AS index,
  round(100.0::DOUBLE + n_nationkey + 74.0 * c, 6) AS x, round(50.0::DOUBLE + 134.0 * r, 6) AS y,
  round(100.0::DOUBLE + n_nationkey + 74.0 * c - 37.0 * 1.1, 6) AS x0, CAST(greatest(floor(100.0 + n_nationkey + 74.0 * c - 37.0) - 2, 0) AS INTEGER) AS box_x0
FROM k""",
)
def plate_cells(t):
    """The 28 cells of one plate per nation, each plate shifted by its key."""
    frames = t.nation.select(
        "n_nationkey", F.array((F.col("n_nationkey") + 100).cast("double"), F.lit(50.0)).alias("origin"),
        F.array(F.lit(74.0), F.lit(0.0)).alias("e_col"), F.array(F.lit(0.0), F.lit(134.0)).alias("e_row"),
    )
    cells = P.cells_from_frame(frames, ["n_nationkey"])
    quad = P.quad(F.col("corners"), F.col("center"))
    box = P.bbox(F.col("corners"), F.lit(2000), F.lit(2000))
    return cells.select(
        "n_nationkey", "row", "col", "kind", "name", "index", r6(F.col("center")[0]).alias("x"), r6(F.col("center")[1]).alias("y"),
        r6(quad[0][0]).alias("x0"), box["x0"].alias("box_x0"),
    )


SEEDS = """seeds AS (SELECT o_custkey, day(o_orderdate) % 7 AS i, month(o_orderdate) % 4 AS j FROM orders),
marks AS (SELECT o_custkey, CAST(o_orderkey % 4 AS INTEGER) AS marker_id, max((day(o_orderdate) % 7) * 10 + month(o_orderdate) % 4) AS p
          FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)"""


@query(
    "pose_search",
    f"""WITH {SEEDS},
cand AS (SELECT pose, fr, fc, dr, dc, CAST(row_number() OVER (ORDER BY n, dr, dc) - 1 AS INTEGER) AS cand FROM
  (VALUES (0, 'identity', false, false), (1, 'flip_col', false, true), (2, 'flip_row', true, false), (3, 'rot180', true, true)) p(n, pose, fr, fc),
  (SELECT unnest(range(-2, 3)) AS dr) a, (SELECT unnest(range(-2, 3)) AS dc) b),
spots AS (SELECT o_custkey, i, j, count(*) AS m FROM seeds GROUP BY 1, 2, 3),
moved AS (SELECT o_custkey, m, cand, (CASE WHEN fr THEN 3 - j ELSE j END) + dr AS r, (CASE WHEN fc THEN 6 - i ELSE i END) + dc AS c FROM spots, cand),
base AS (SELECT o_custkey, cand, sum(CASE WHEN r BETWEEN 0 AND 3 AND c BETWEEN 0 AND 6 AND NOT {KERNEL} THEN 3.0 ELSE -2.0 END - 2 * (m - 1)) - 44 AS s
  FROM moved GROUP BY 1, 2),
mark AS (SELECT o_custkey, cand, sum(CASE WHEN (marker_id IN (0, 3) AND r = 3 AND c = 3) OR (marker_id IN (1, 2) AND r = 2 AND c = 6) THEN 8.0 ELSE -8.0 END) AS v
  FROM (SELECT o_custkey, marker_id, cand, (CASE WHEN fr THEN 3 - p % 10 ELSE p % 10 END) + dr AS r, (CASE WHEN fc THEN 6 - p // 10 ELSE p // 10 END) + dc AS c
        FROM marks, cand) GROUP BY 1, 2),
ranked AS (SELECT b.o_custkey, cand, CAST(s + coalesce(v, 0) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY b.o_custkey ORDER BY s + coalesce(v, 0) DESC, cand) AS k FROM base b LEFT JOIN mark m USING (o_custkey, cand))
SELECT a.o_custkey, a.cand, a.score, a.score - b.score AS margin FROM ranked a JOIN ranked b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2""",
)
def pose_search(t):
    i, j = F.dayofmonth("o_orderdate") % 7, F.month("o_orderdate") % 4
    seeds = t.orders.select("o_custkey", i.alias("i"), j.alias("j"))
    marks = t.orders.where("o_orderpriority = '1-URGENT'").select(
        "o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("marker_id"), i.alias("i"), j.alias("j")
    )
    return L.choose_pose(seeds, marks, ["o_custkey"]).select("o_custkey", "cand", "score", "margin")


@query(
    "fit_plates",
    f"""WITH w AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS idx FROM (SELECT unnest(range(4)) AS r) a, (SELECT unnest(range(7)) AS c) b WHERE NOT {KERNEL}),
p AS (SELECT c_custkey // 22 AS plate, r::DOUBLE AS r, c::DOUBLE AS c, CASE WHEN c_custkey // 22 % 2 = 1 THEN -1 ELSE 1 END AS turn,
    (CAST(abs(round(c_acctbal * 100)) AS BIGINT) % 7 - 3)::DOUBLE AS dx, (c_nationkey % 7 - 3)::DOUBLE AS dy FROM customer JOIN w ON idx = c_custkey % 22 WHERE c_acctbal >= -500),
s AS (SELECT *, turn * c * (74 + plate % 3) + dx AS x, turn * r * 134 + dy AS y FROM p),
m AS (SELECT plate, min(turn) AS turn, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(c) AS mc, avg(r) AS mr, var_pop(c) AS vc, var_pop(r) AS vr, covar_pop(c, r) AS cr,
    covar_pop(c, x) AS cx, covar_pop(r, x) AS rx, covar_pop(c, y) AS cy, covar_pop(r, y) AS ry FROM s GROUP BY plate),
f AS (SELECT *, (cx * vr - cr * rx) / (vc * vr - cr * cr) AS ax, (rx * vc - cr * cx) / (vc * vr - cr * cr) AS bx,
    (cy * vr - cr * ry) / (vc * vr - cr * cr) AS ay, (ry * vc - cr * cy) / (vc * vr - cr * cr) AS ey FROM m WHERE n >= 8),
e AS (SELECT plate, sqrt(avg((x - mx - ax * (c - mc) - bx * (r - mr)) ** 2 + (y - my - ay * (c - mc) - ey * (r - mr)) ** 2)) AS rms FROM s JOIN f USING (plate) GROUP BY plate),
k AS (SELECT plate, id, turn * 1.0 * kc * (74 + plate % 3) + CASE WHEN plate % 5 = 1 AND id = 1 THEN 50 ELSE 0 END AS x, turn * 134.0 * kr AS y, kc, kr FROM m, (VALUES (0, 3, 3), (1, 2, 6)) v(id, kr, kc)),
o AS (SELECT plate, count(*) FILTER ((k.x - mx - ax * (kc - mc) - bx * (kr - mr)) ** 2 + (k.y - my - ay * (kc - mc) - ey * (kr - mr)) ** 2 > 1600) AS off FROM k JOIN f USING (plate) GROUP BY plate)
SELECT m.plate, CASE WHEN m.n >= 8 THEN CASE WHEN m.turn = 1 THEN 'identity' ELSE 'rot180' END END AS pose, round(rms, 6) AS rms, CAST(m.n AS BIGINT) AS n_seeds,
  round(sqrt(ax * ax + ay * ay), 6) AS pitch_x, round(sqrt(bx * bx + ey * ey), 6) AS pitch_y, CASE WHEN m.n >= 8 THEN 'right' END AS chirality, CAST(coalesce(off, 0) AS BIGINT) AS markers_off,
  CASE WHEN m.n < 8 THEN 'too_few_wells' ELSE '' END AS reasons
FROM m LEFT JOIN f USING (plate) LEFT JOIN e ON e.plate = m.plate LEFT JOIN o ON o.plate = m.plate""",
)
def fit_plates(t):
    """One plate per 22 customers: every second one turned, wells moved and left out by balance,
    the pitch by plate, and every fifth plate with a marker 50 pixels from its cell."""
    well = P.cells(t.spark).where("kind = 'kernel'").select("row", "col", "index")
    plate, turn = F.floor(F.col("c_custkey") / 22), F.when(F.floor(F.col("c_custkey") / 22) % 2 == 1, -1.0).otherwise(1.0)
    c = t.customer.where("c_acctbal >= -500").select(
        plate.alias("plate"), turn.alias("turn"), F.col("c_custkey").alias("seed"), (F.col("c_custkey") % 22).cast("int").alias("index"),
        (F.abs(F.round(F.col("c_acctbal") * 100)).cast("bigint") % 7 - 3).cast("double").alias("dx"), (F.col("c_nationkey") % 7 - 3).cast("double").alias("dy"),
    )
    wide = (F.col("plate") % 3 + 74).cast("double")
    seeds = c.join(F.broadcast(well), "index").select(
        "plate", "seed", (F.col("turn") * F.col("col") * wide + F.col("dx")).alias("x"), (F.col("turn") * F.col("row") * 134.0 + F.col("dy")).alias("y")
    )
    ids = F.explode(F.array(*[F.struct(F.lit(m).alias("marker_id"), F.lit(r).alias("r"), F.lit(k).alias("k")) for m, (r, k) in ((0, (3, 3)), (1, (2, 6)))]))
    off = F.when((F.col("plate") % 5 == 1) & (F.col("m.marker_id") == 1), 50.0).otherwise(0.0)
    marks = c.select("plate", "turn").distinct().withColumn("m", ids).select(
        "plate", "m.marker_id", (F.col("turn") * F.col("m.k") * wide + off).alias("x"), (F.col("turn") * F.col("m.r") * 134.0).alias("y")
    )
    out = L.fit_plates(seeds, marks, ["plate"])
    return out.select(
        "plate", "pose", r6("rms").alias("rms"), "n_seeds", r6("pitch_x").alias("pitch_x"), r6("pitch_y").alias("pitch_y"), "chirality",
        "markers_off", F.array_join("reasons", ",").alias("reasons"),
    )


OCC = """occ AS (
  SELECT c_nationkey AS dish, o_orderstatus || substr(o_orderpriority, 1, 1) AS capture, CAST(o_custkey % 22 AS INTEGER) AS well,
         avg(o_totalprice) / 500000 AS occ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
)"""


def occupancy(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dish"))
    capture = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    return t.orders.join(c, "o_custkey").groupBy("dish", capture.alias("capture"), (F.col("o_custkey") % 22).cast("int").alias("well")).agg(
        (F.avg("o_totalprice") / 500000).alias("occ")
    )


@query(
    "leave_one_out_median",
    f"""WITH {OCC} SELECT a.dish, a.capture, a.well, round((SELECT quantile_cont(b.occ, 0.5) FROM occ b
  WHERE b.dish = a.dish AND b.well = a.well AND b.capture <> a.capture), 6) AS ref FROM occ a""",
)
def leave_one_out_median(t):
    occ = occupancy(t)
    number = F.conv(F.hex("capture"), 16, 10).cast("bigint")
    out = C.leave_one_out_median(occ.withColumn("k", number), ["dish", "well"], "k", "occ")
    return rounded(out.select("dish", "capture", "well", "ref"), "ref")


AGREE = f"""{OCC}, st AS (SELECT dish, capture, count(*) AS k, avg(occ) AS m, stddev_pop(occ) AS s FROM occ GROUP BY 1, 2),
z AS (SELECT dish, capture, well, (occ - m) / s AS z FROM occ JOIN st USING (dish, capture) WHERE k >= 4 AND s >= 1e-9),
ref AS (SELECT a.dish, a.capture, a.well, a.z, (SELECT quantile_cont(b.z, 0.5) FROM z b WHERE b.dish = a.dish AND b.well = a.well AND b.capture <> a.capture) AS ref FROM z a),
tr AS (SELECT dish, capture, CASE WHEN count(*) > 3 THEN corr(z, ref) END AS corr FROM ref WHERE ref IS NOT NULL GROUP BY 1, 2),
w AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS idx FROM (SELECT unnest(range(4)) AS r) a, (SELECT unnest(range(7)) AS c) b WHERE NOT {KERNEL}),
mv AS (SELECT pose, o, w.idx AS well, v.idx AS other FROM w, (VALUES (0, 'flip_col', false, true), (1, 'flip_row', true, false), (2, 'rot180', true, true)) p(o, pose, fr, fc)
  JOIN w v ON v.r = CASE WHEN fr THEN 3 - w.r ELSE w.r END AND v.c = CASE WHEN fc THEN 6 - w.c ELSE w.c END),
wr AS (SELECT f.dish, f.capture, pose, o, CASE WHEN count(*) > 3 THEN corr(z.z, f.ref) END AS corr FROM ref f JOIN mv ON mv.well = f.well
  JOIN z ON z.dish = f.dish AND z.capture = f.capture AND z.well = mv.other WHERE f.ref IS NOT NULL GROUP BY 1, 2, 3, 4),
bw AS (SELECT *, row_number() OVER (PARTITION BY dish, capture ORDER BY corr DESC, o) AS k FROM wr WHERE corr IS NOT NULL)
SELECT tr.dish, tr.capture, round(tr.corr, 6) AS corr, bw.pose AS best_wrong_pose, round(bw.corr, 6) AS best_wrong_corr, round(tr.corr - bw.corr, 6) AS margin,
  CASE WHEN tr.corr IS NULL OR tr.corr < 0.45 THEN 'not_tracking' WHEN tr.corr - bw.corr < 0 THEN 'wrong_pose_fits_better'
       WHEN tr.corr - bw.corr < 0.05 THEN 'weak' ELSE 'ok' END AS verdict
FROM tr LEFT JOIN bw ON bw.dish = tr.dish AND bw.capture = tr.capture AND bw.k = 1"""


@query("pose_agreement", f"WITH {AGREE}")
def pose_agreement(t):
    occ = occupancy(t)
    number = F.conv(F.hex("capture"), 16, 10).cast("bigint")
    out = C.pose_agreement(occ.withColumn("k", number), "dish", "k", "well", "occ")
    names = occ.select("dish", "capture", number.alias("k")).distinct()
    out = out.join(names, ["dish", "k"]).drop("k")
    return rounded(out, "corr", "best_wrong_corr", "margin")


@query(
    "occupancy_breaks",
    f"""WITH {OCC} SELECT dish, well, CAST(count(*) FILTER (occ >= 0.3) AS BIGINT) AS filled, CAST(count(*) AS BIGINT) AS seen
FROM occ GROUP BY 1, 2 HAVING count(*) FILTER (occ >= 0.3) > 0 AND count(*) FILTER (occ >= 0.3) <> count(*)""",
)
def occupancy_breaks(t):
    return C.occupancy_breaks(occupancy(t), ["dish", "well"], "occ", 0.3)


CAPS = """caps AS (
  SELECT c_nationkey AS dish, c_custkey AS capture, CASE WHEN c_mktsegment < 'F' THEN 'dorsal' ELSE 'ventral' END AS side,
    CASE WHEN c_acctbal < -900 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN c_acctbal > 9500 THEN 'dorsal' END AS side_observed,
    CASE WHEN c_acctbal > 9990 THEN 'L' ELSE 'R' END AS chirality, 70 + c_acctbal / 2500 AS pitch_x, 130 + c_acctbal / 1000 AS pitch_y FROM customer
)"""


@query(
    "capture_exceptions",
    f"""WITH {CAPS}, us AS (SELECT * FROM caps WHERE status <> 'fail')
SELECT dish, 'failed' AS kind, capture::VARCHAR AS subject, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM caps WHERE status = 'fail' UNION ALL
SELECT dish, 'side_mismatch', capture::VARCHAR, NULL, NULL FROM us WHERE side_observed <> side UNION ALL
SELECT dish, 'handedness', side, NULL, NULL FROM us GROUP BY dish, side HAVING min(chirality) <> max(chirality) UNION ALL
SELECT dish, 'pitch_x_spread', 'pitch_x', round(min(pitch_x), 6), round(max(pitch_x), 6) FROM us GROUP BY dish HAVING max(pitch_x) - min(pitch_x) > 4 UNION ALL
SELECT dish, 'pitch_y_spread', 'pitch_y', round(min(pitch_y), 6), round(max(pitch_y), 6) FROM us GROUP BY dish HAVING max(pitch_y) - min(pitch_y) > 7""",
)
def capture_exceptions(t):
    bal = F.col("c_acctbal")
    caps = t.customer.select(
        F.col("c_nationkey").alias("dish"), F.col("c_custkey").alias("capture"),
        F.when(F.col("c_mktsegment") < "F", "dorsal").otherwise("ventral").alias("side"),
        F.when(bal < -900, "fail").otherwise("pass").alias("status"), F.when(bal > 9500, "dorsal").alias("side_observed"),
        F.when(bal > 9990, "L").otherwise("R").alias("chirality"), (bal / 2500 + 70).alias("pitch_x"), (bal / 1000 + 130).alias("pitch_y"),
    )
    return rounded(C.capture_exceptions(caps), "low", "high")


@query(
    "null_safe_corr",
    """SELECT l_returnflag, l_linestatus, round(CASE WHEN count(*) > 3 THEN corr(l_quantity, l_extendedprice) END, 6) AS corr,
CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""",
)
def null_safe_corr(t):
    return rounded(C.null_safe_corr(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice"), "corr")


@query(
    "merge_reads",
    """WITH p AS (SELECT o_custkey, o_orderstatus, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k FROM orders)
SELECT o_custkey, arg_max(o_totalprice, (k, o_totalprice)) AS o_totalprice FROM p GROUP BY o_custkey""",
)
def merge_reads(t):
    passes = [t.orders.where(F.col("o_orderstatus") == s) for s in "FOP"]
    return C.merge_reads(*passes, key=["o_custkey"], value="o_totalprice")


@query(
    "winning_side",
    """WITH v AS (SELECT o_custkey, o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 10.0 ELSE o_totalprice / 500000 END) AS v FROM orders GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderstatus) AS k FROM v)
SELECT o.o_custkey, o.o_orderstatus, o.o_orderkey FROM orders o JOIN b ON b.o_custkey = o.o_custkey AND b.o_orderstatus = o.o_orderstatus AND b.k = 1""",
)
def winning_side(t):
    reads = t.orders.select(
        "o_custkey", "o_orderstatus", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("exact"), (F.col("o_totalprice") / 500000).alias("score")
    )
    return C.winning_side(reads, ["o_custkey"], "o_orderstatus", "exact", "score").select("o_custkey", "o_orderstatus", "o_orderkey")
