"""The correction plans over the embedding table read as raw captures and calibration captures.

Four captures of eight sensor rows come from ``vec_id``; two on day 1, one on day 2 with calibration of
its own, one on day 3, whose white is doubled.  The same vectors, dealt by ``vec_id % 5``, are the
lines of the calibration captures; every sixth round of lines is blank.
"""

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import nearby
from ..operators import radiometry as R
from ..session import settle, written
from . import correction as P
from .registry import query, r6

BANDS, FULL = 64, 2900.0
FOLDERS = ("dark_sample/2500", "day2/dark_sample/2k", "dark_white/2100", "white/2100", "day2/white/2000")
CATALOG = [
    ("dark_sample", None, FOLDERS[0]), ("dark_sample", 2, FOLDERS[1]), ("dark_white", None, FOLDERS[2]), ("white", None, FOLDERS[3]),
    ("white", 2, FOLDERS[4]), ("white", 3, FOLDERS[3]), ("white", 3, FOLDERS[4]), ("dark", None, FOLDERS[0]), ("dark", 2, FOLDERS[1]),
]
CAPTURES = [("cap0", 1, 0.6), ("cap1", 1, 1.0), ("cap2", 2, 1.4), ("cap3", 3, 1.0)]


def count_of(x, gain, lift):
    return F.floor((x + lift) * gain).cast("double")


def cube(t):
    v = F.col("vec_id")
    c = F.transform(F.col("embedding").cast("array<double>"), lambda x: count_of(x, 2000.0, 1.0))
    return t.embeddings.select(F.concat(F.lit("cap"), F.expr("vec_id div 8 % 4")).alias("capture"), (v % 8).alias("row"), F.expr("vec_id div 32").alias("line"), c.alias("c"))


def calibration_lines(t):
    e, f = F.col("embedding").cast("array<double>"), F.col("vec_id") % 5
    blank = F.expr("vec_id div 40 % 6 = 5")
    c = F.when(blank, F.transform(e, lambda x: F.lit(0.0))).when(f >= 3, F.transform(e, lambda x: count_of(x, 1000.0, 2.0))).when(
        f == 2, F.transform(e, lambda x: count_of(x, 100.0, 1.0))).otherwise(F.transform(e, lambda x: count_of(x, 200.0, 1.0)))
    folder = F.get(F.array(*map(F.lit, FOLDERS)), f.cast("int"))
    return t.embeddings.select(folder.alias("folder"), F.expr("vec_id div 5 % 8").alias("row"), c.alias("c"))


def inputs(t):
    catalog = t.spark.createDataFrame(CATALOG, "kind string, day int, folder string")
    return catalog, t.spark.createDataFrame(CAPTURES, "capture string, day int, factor double")


def transmittance_plan(t):
    catalog, captures = inputs(t)
    bundle = C.transmittance_bundle(catalog, captures)
    cells = settle(C.reference_cells(calibration_lines(t), bundle, "row", "c", 0.97, 1.05))
    return P.correct_transmittance(cube(t), captures, bundle, cells, BANDS, FULL, 4, 100)


BASE = """
long AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS band FROM embeddings),
cube AS (SELECT 'cap' || (vec_id // 8 % 4) AS capture, vec_id % 8 AS row, vec_id // 32 AS line, band, floor((x + 1.0) * 2000.0) AS c FROM long),
cal AS (SELECT vec_id % 5 AS f, vec_id // 5 % 8 AS row, band, CASE WHEN vec_id % 5 >= 3 THEN floor((x + 2.0) * 1000.0)
  WHEN vec_id % 5 = 2 THEN floor((x + 1.0) * 100.0) ELSE floor((x + 1.0) * 200.0) END AS c FROM long WHERE vec_id // 40 % 6 <> 5)"""
#: resampled AS (capture, row, line, band, x): of filled (capture, row, line, band, x, sat) by about (capture, factor)
RESCALE = """
dims AS (SELECT capture, n, factor, greatest(1, round(n * factor))::BIGINT AS new FROM (SELECT capture, max(line) + 1 AS n FROM filled GROUP BY capture) JOIN about USING (capture)),
outs AS (SELECT *, unnest(range(new)) AS o, n::DOUBLE / new AS step FROM dims),
reach AS (SELECT *, greatest(0.0, least(n - 1.0, (o + 0.5) * step - 0.5)) AS pos, unnest(range(n)) AS s FROM outs),
w AS (SELECT capture, o, s, CASE WHEN new = n THEN (s = o)::INT::DOUBLE WHEN factor < 1 THEN least((o + 1) * step, s + 1.0) - greatest(o * step, s::DOUBLE)
  ELSE (s = floor(pos))::INT * (1 - (pos - floor(pos))) + (s = least(floor(pos) + 1, n - 1))::INT * (pos - floor(pos)) END AS w FROM reach),
scaled AS (SELECT f.capture, f.row, w.o AS line, f.band, sum(f.x * w.w) / sum(w.w) AS x, bool_or(f.sat) AS sat
  FROM filled f JOIN w ON w.capture = f.capture AND w.s = f.line AND w.w > 1e-9 GROUP BY f.capture, f.row, w.o, f.band)"""
TRANS = f"""{BASE},
frame AS (SELECT f, row, band, quantile_cont(c, 0.5) AS v FROM cal GROUP BY f, row, band),
sets AS (SELECT * FROM (VALUES ('A', 0, 3), ('B', 1, 4)) s(s, d, b)),
about AS (SELECT * FROM (VALUES ('cap0', 'A', 2100.0::DOUBLE / 2500, 0.6::DOUBLE), ('cap1', 'A', 2100.0::DOUBLE / 2500, 1.0), ('cap2', 'B', 1.0, 1.4)) a(capture, s, k, factor)),
two AS (SELECT s, d.row, d.band, d.v AS dark, w.v - u.v AS w FROM sets JOIN frame d ON d.f = sets.d JOIN frame w ON w.f = sets.b AND w.row = d.row AND w.band = d.band
  JOIN frame u ON u.f = 2 AND u.row = d.row AND u.band = d.band),
judged AS (SELECT *, dark > 1.05 * quantile_cont(dark, 0.5) OVER (PARTITION BY s) AS hot, quantile_cont(w, 0.5) OVER (PARTITION BY s, band) AS typical FROM two),
ok AS (SELECT *, w >= 100 AND w >= 0.15 * typical AND NOT hot AS cell_valid FROM judged),
levels AS (SELECT s, band, coalesce(quantile_cont(w, 0.5) FILTER (cell_valid), 0.0) AS l FROM ok GROUP BY s, band),
kept AS (SELECT s, band, l >= 0.97 * max(l) OVER (PARTITION BY s) AS kept FROM levels),
cells AS (SELECT ok.*, kept, cell_valid AND kept AS valid FROM ok JOIN kept USING (s, band)),
lit AS (SELECT capture, s, row, line, band, c, (c - dark) / w * k AS u, cell_valid, CASE WHEN valid THEN (c - dark) / w * k ELSE 'NaN'::DOUBLE END AS t, c >= 2900 AS sat
  FROM cube JOIN about USING (capture) JOIN cells USING (s, row, band)),
near AS (SELECT b.s, b.row, b.band, g.row AS src_row, g.band AS src_band FROM cells b JOIN cells g
  ON g.s = b.s AND g.valid AND abs(g.row - b.row) <= 1 AND abs(g.band - b.band) <= 1 WHERE NOT b.valid AND b.kept),
enough AS (SELECT s, row, band FROM near GROUP BY s, row, band HAVING count(*) >= 4),
fixed AS (SELECT g.capture, n.row, g.line, n.band, avg(g.t) AS t FROM near n JOIN enough USING (s, row, band)
  JOIN lit g ON g.s = n.s AND g.row = n.src_row AND g.band = n.src_band GROUP BY g.capture, n.row, g.line, n.band),
filled AS (SELECT l.capture, l.row, l.line, l.band, coalesce(f.t, l.t) AS x, l.sat FROM lit l
  LEFT JOIN fixed f ON f.capture = l.capture AND f.row = l.row AND f.line = l.line AND f.band = l.band),{RESCALE}"""


@query(
    "correct_transmittance",
    f"""WITH {TRANS} SELECT capture, row, line, CAST(band AS INTEGER) AS band, CASE WHEN NOT isnan(x) THEN round(x, 6) + 0.0 END AS t, sat FROM scaled""",
)
def correct_transmittance(t):
    """Every cell of the corrected cubes; invalid ones stay, without a value."""
    out = transmittance_plan(t).cube.select("capture", "row", "line", F.posexplode(F.arrays_zip("t", "sat")).alias("band", "z"))
    return out.select("capture", "row", "line", "band", F.when(~F.isnan("z.t"), r6("z.t")).alias("t"), F.col("z.sat").alias("sat"))


QUALITY = [
    "saturated_frac", "valid_unsaturated_frac", "above_one", "t_min", "t_max", "fully_in_range_frac", "p1", "median", "p99", "open_beam",
    "stretch_lo", "stretch_hi", "stretch_share", "invalid_frac", "k",
]


@query(
    "transmittance_quality",
    f"""WITH {TRANS},
days AS (SELECT * FROM (VALUES ('cap0', 1, 'A', 2100.0::DOUBLE / 2500, false, NULL), ('cap1', 1, 'A', 2100.0::DOUBLE / 2500, false, NULL), ('cap2', 2, 'B', 1.0, true, NULL),
  ('cap3', 3, NULL, NULL, NULL, 'more than one white')) d(capture, day, s, k, exposures_differ, problem)),
raw AS (SELECT capture, max(line) + 1 AS lines, avg((c >= 2900)::INT::DOUBLE) AS saturated_frac FROM cube GROUP BY capture),
blank AS (SELECT capture, count(*) FILTER (top = 0) AS blank_rows FROM (SELECT capture, row, line, max(c) AS top FROM cube GROUP BY ALL) GROUP BY capture),
told AS (SELECT z.*, c.valid, c.kept, c.valid AND NOT z.sat AND NOT isnan(x) AS good FROM scaled z JOIN about USING (capture) JOIN cells c USING (s, row, band)),
px AS (SELECT capture, row, line, avg(x) FILTER (kept AND NOT isnan(x)) AS m, avg(sat::INT::DOUBLE) FILTER (kept) AS clip FROM told GROUP BY capture, row, line),
spread AS (SELECT capture, count(DISTINCT line) AS lines_out, avg((valid AND NOT sat)::INT::DOUBLE) AS valid_unsaturated_frac,
  avg((x > 1)::INT::DOUBLE) FILTER (good) AS above_one, min(x) FILTER (good) AS t_min, max(x) FILTER (good) AS t_max,
  quantile_cont(x, 0.01) FILTER (good) AS p1, quantile_cont(x, 0.5) FILTER (good) AS median, quantile_cont(x, 0.99) FILTER (good) AS p99 FROM told GROUP BY capture),
pixels AS (SELECT capture, coalesce(avg((clip = 0)::INT::DOUBLE) FILTER (m IS NOT NULL), 0.0) AS fully_in_range_frac, count(*) AS n,
  count(*) FILTER (m IS NOT NULL AND clip <= 0.02) AS n_clean FROM px GROUP BY capture),
pop AS (SELECT px.capture, log10(greatest(m, 0.0001)) AS v FROM px JOIN pixels USING (capture) WHERE m IS NOT NULL AND (clip <= 0.02 OR n_clean < 100)),
stretch AS (SELECT capture, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi, count(*) AS k FROM pop GROUP BY capture),
clip AS (SELECT capture, s, band, avg(sat::INT::DOUBLE) AS clip FROM lit GROUP BY capture, s, band),
beam AS (SELECT s, band, count(*) FILTER (cell_valid) AS n FROM cells GROUP BY s, band),
cand AS (SELECT lit.* FROM lit JOIN clip USING (capture, s, band) JOIN beam USING (s, band) WHERE cell_valid AND clip <= 0.01 AND n >= 4),
cut AS (SELECT capture, band, quantile_cont(c, 0.9) AS cut FROM cand GROUP BY capture, band),
per_band AS (SELECT capture, band, quantile_cont(u, 0.5) AS m FROM cand JOIN cut USING (capture, band) WHERE c >= cut GROUP BY capture, band),
open AS (SELECT capture, count(*) AS open_beam_bands, quantile_cont(m, 0.5) AS open_beam FROM per_band GROUP BY capture),
refs AS (SELECT s, count(DISTINCT band) FILTER (kept) AS bands_kept, avg((NOT valid)::INT::DOUBLE) AS invalid_frac, count(*) FILTER (hot) AS hot_cells,
  (SELECT count(*) FROM enough e WHERE e.s = cells.s) AS filled_cells FROM cells GROUP BY s)
SELECT capture, day, round(d.k, 6) AS k, exposures_differ, problem, CAST(lines AS BIGINT) AS lines, CAST(blank_rows AS BIGINT) AS blank_rows, round(saturated_frac, 6) AS saturated_frac,
  CAST(lines_out AS BIGINT) AS lines_out, round(valid_unsaturated_frac, 6) AS valid_unsaturated_frac, round(above_one, 6) AS above_one,
  CASE WHEN lines_out IS NOT NULL THEN coalesce(above_one > 0.001, false) END AS unphysical, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max,
  round(p1, 6) AS p1, round(median, 6) AS median, round(p99, 6) AS p99, round(fully_in_range_frac, 6) AS fully_in_range_frac,
  CAST(open_beam_bands AS BIGINT) AS open_beam_bands, round(open_beam, 6) AS open_beam, open_beam BETWEEN 0.8 AND 1.25 AS open_beam_ok,
  round(10 ** lo, 6) AS stretch_lo, round(10 ** CASE WHEN hi <= lo THEN lo + 1 ELSE hi END, 6) AS stretch_hi, round(stretch.k::DOUBLE / pixels.n, 6) AS stretch_share,
  CAST(bands_kept AS BIGINT) AS bands_kept, round(invalid_frac, 6) AS invalid_frac, CAST(hot_cells AS BIGINT) AS hot_cells, CAST(filled_cells AS BIGINT) AS filled_cells
FROM days d LEFT JOIN raw USING (capture) LEFT JOIN blank USING (capture) LEFT JOIN spread USING (capture) LEFT JOIN pixels USING (capture)
LEFT JOIN stretch USING (capture) LEFT JOIN open USING (capture) LEFT JOIN refs USING (s)""",
)
def transmittance_quality(t):
    out = transmittance_plan(t).quality
    return out.select(*[r6(c).alias(c) if c in QUALITY else F.col(c) for c in out.columns])


def tape(t):
    px = cube(t).select("capture", "row", "line").distinct()
    return px.where("capture <> 'cap2' AND row <> 3 AND line BETWEEN 2 AND 9 AND (row * 7 + line) % 5 <> 0 AND (row <> 6 OR line < 5)")


def reflectance_plan(t):
    catalog, captures = inputs(t)
    dark = written(R.reference_frame(calibration_lines(t), ["folder", "row"], "c", BANDS, "mean", "dark"), "dark")
    return P.correct_reflectance(cube(t), captures, C.reflectance_bundle(catalog, captures), dark, settle(tape(t)), BANDS, coverage=0.9, full_scale=FULL)


REFL = f"""{BASE},
dark AS (SELECT f, row, band, avg(c) AS dark FROM cal WHERE f < 2 GROUP BY f, row, band),
about AS (SELECT * FROM (VALUES ('cap0', 0, 0.6::DOUBLE), ('cap1', 0, 1.0), ('cap2', 1, 1.4), ('cap3', 0, 1.0)) a(capture, f, factor)),
sub AS (SELECT capture, row, line, band, c < dark AS below, floor(greatest(c - dark, 0.0)) AS c FROM cube JOIN about USING (capture) JOIN dark USING (f, row, band)),
tape AS (SELECT DISTINCT capture, row, line FROM cube WHERE capture <> 'cap2' AND row <> 3 AND line BETWEEN 2 AND 9 AND (row * 7 + line) % 5 <> 0 AND (row <> 6 OR line < 5)),
span AS (SELECT capture, min(line) AS first_line, max(line) AS last_line, count(*) AS tape_pixels FROM tape GROUP BY capture),
counts AS (SELECT capture, row, count(*) AS k FROM tape GROUP BY capture, row),
enough AS (SELECT capture, row, k >= 0.9 * quantile_cont(k, 0.5) OVER (PARTITION BY capture) AS e FROM counts),
trusted AS (SELECT capture, row, e OR NOT bool_or(e) OVER (PARTITION BY capture) AS trusted FROM enough),
known AS (SELECT capture, row, band, quantile_cont(c, 0.75) AS w FROM sub JOIN tape USING (capture, row, line) JOIN trusted USING (capture, row) WHERE trusted GROUP BY capture, row, band),
spine AS (SELECT DISTINCT capture, row, band FROM sub),
ends AS (SELECT s.*, (SELECT max(k.row) FROM known k WHERE k.capture = s.capture AND k.band = s.band AND k.row <= s.row) AS r0,
  (SELECT min(k.row) FROM known k WHERE k.capture = s.capture AND k.band = s.band AND k.row >= s.row) AS r1 FROM spine s),
white AS (SELECT e.capture, e.row, e.band, coalesce(CASE WHEN a.w IS NULL THEN b.w WHEN b.w IS NULL OR r0 = r1 THEN a.w ELSE a.w + (b.w - a.w) * (e.row - r0)::DOUBLE / (r1 - r0) END, 1.0) AS w
  FROM ends e LEFT JOIN known a ON a.capture = e.capture AND a.row = r0 AND a.band = e.band LEFT JOIN known b ON b.capture = e.capture AND b.row = r1 AND b.band = e.band),
filled AS (SELECT capture, row, line - coalesce(first_line, 0) AS line, band, c / w AS x, false AS sat FROM sub JOIN white USING (capture, row, band) LEFT JOIN span USING (capture)
  WHERE first_line IS NULL OR line BETWEEN first_line AND last_line),{RESCALE}"""


@query(
    "correct_reflectance",
    f"""WITH {REFL} SELECT capture, row, line, CAST(band AS INTEGER) AS band, round(x, 6) + 0.0 AS r FROM scaled""",
)
def correct_reflectance(t):
    out = reflectance_plan(t).cube.select("capture", "row", "line", F.posexplode("r").alias("band", "r"))
    return out.select("capture", "row", "line", "band", r6("r").alias("r"))


@query(
    "reflectance_quality",
    f"""WITH {REFL},
raw AS (SELECT capture, max(line) + 1 AS lines, avg((c >= 2900)::INT::DOUBLE) AS saturated_frac FROM cube GROUP BY capture),
px AS (SELECT capture, row, line, avg(x) AS m FROM scaled GROUP BY capture, row, line),
stretch AS (SELECT capture, quantile_cont(m, 0.01) AS lo, quantile_cont(m, 0.99) AS hi FROM px GROUP BY capture),
rows AS (SELECT capture, count(DISTINCT row) AS n FROM sub GROUP BY capture), t AS (SELECT capture, count(*) FILTER (trusted) AS n FROM trusted GROUP BY capture),
below AS (SELECT capture, count(*) FILTER (below) AS n FROM sub GROUP BY capture),
r AS (SELECT capture, min(x) AS r_min, max(x) AS r_max, avg(x) AS r_mean, count(DISTINCT line) AS lines_kept FROM filled GROUP BY capture),
d AS (SELECT * FROM (VALUES ('cap0', 1), ('cap1', 1), ('cap2', 2), ('cap3', 3)) d(capture, day))
SELECT capture, d.day, NULL::VARCHAR AS problem, CAST(lines AS BIGINT) AS lines, 0::BIGINT AS blank_rows, round(saturated_frac, 6) AS saturated_frac, CAST(below.n AS BIGINT) AS n_below_dark,
  CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line, CAST(tape_pixels AS BIGINT) AS tape_pixels,
  CAST(coalesce(t.n, 0) AS BIGINT) AS trusted_rows, CAST(rows.n - coalesce(t.n, 0) AS BIGINT) AS interpolated_rows,
  round(r_min, 6) AS r_min, round(r_max, 6) AS r_max, round(r_mean, 6) AS r_mean, CAST(lines_kept AS BIGINT) AS lines_kept, round(lo, 6) AS stretch_lo, round(hi, 6) AS stretch_hi
FROM d JOIN raw USING (capture) JOIN below USING (capture) LEFT JOIN span USING (capture) JOIN rows USING (capture) LEFT JOIN t USING (capture) JOIN r USING (capture) JOIN stretch USING (capture)""",
)
def reflectance_quality(t):
    out = reflectance_plan(t).quality
    return out.select(*[r6(c).alias(c) if c in ("saturated_frac", "r_min", "r_max", "r_mean", "stretch_lo", "stretch_hi") else F.col(c) for c in out.columns])


#: no length becomes a half, which engines round differently
AXES = [("cap0", 0.6, 1.5), ("cap1", 1.4, 0.7), ("cap2", 1.0, 1.3), ("cap3", 0.2, 0.4)]


def axis_sql(axis, n, f, by, src):
    """The axis ``axis`` of table ``src`` resampled by ``f``, the axis ``by`` left alone."""
    return f"""
{axis}_outs AS (SELECT *, unnest(range(new)) AS o, {n}::DOUBLE / new AS step FROM (SELECT capture, {n}, {f}, greatest(1, round({n} * {f}))::BIGINT AS new FROM dims)),
{axis}_w AS (SELECT capture, o, s, CASE WHEN new = {n} THEN (s = o)::INT::DOUBLE WHEN {f} < 1 THEN least((o + 1) * step, s + 1.0) - greatest(o * step, s::DOUBLE)
  ELSE (s = floor(pos))::INT * (1 - (pos - floor(pos))) + (s = least(floor(pos) + 1, {n} - 1))::INT * (pos - floor(pos)) END AS w
  FROM (SELECT *, greatest(0.0, least({n} - 1.0, (o + 0.5) * step - 0.5)) AS pos, unnest(range({n})) AS s FROM {axis}_outs)),
by_{axis} AS (SELECT f.capture, w.o AS {axis}, f.{by}, f.band, sum(f.x * w.w) / sum(w.w) AS x, bool_or(f.sat) AS sat
  FROM {src} f JOIN {axis}_w w ON w.capture = f.capture AND w.s = f.{axis} AND w.w > 1e-9 GROUP BY f.capture, w.o, f.{by}, f.band)"""


@query(
    "resample_two_axes",
    f"""WITH {BASE},
dims AS (SELECT capture, n_line, 8 AS n_row, f_line, f_row FROM (SELECT capture, max(line) + 1 AS n_line FROM cube GROUP BY capture)
  JOIN (SELECT * FROM (VALUES {", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, a, b in AXES)}) v(capture, f_line, f_row)) USING (capture)),
plane AS (SELECT capture, row, line, band, CASE WHEN c >= 2600 THEN 'NaN'::DOUBLE ELSE c END AS x, c >= 2500 AS sat FROM cube WHERE band < 4),
{axis_sql("line", "n_line", "f_line", "row", "plane")},{axis_sql("row", "n_row", "f_row", "line", "by_line")}
SELECT capture, row, line, CAST(band AS INTEGER) AS band, CASE WHEN NOT isnan(x) THEN round(x, 6) END AS x, sat FROM by_row""",
)
def resample_two_axes(t):
    """Shrinking, growing and mixed; a missing value reaches every output that it touches."""
    raw = cube(t).withColumn("c", F.slice("c", 1, 4))
    plane = raw.select("capture", "row", "line", F.transform("c", lambda x: F.when(x >= 2600, F.lit(float("nan"))).otherwise(x)).alias("x"), F.transform("c", lambda x: x >= 2500).alias("sat"))
    dims = raw.groupBy("capture").agg((F.max("line") + 1).alias("n_line")).join(t.spark.createDataFrame(AXES, "capture string, f_line double, f_row double"), "capture").withColumn("n_row", F.lit(8))
    out = R.resample_two_axes(plane, dims, "capture", [], ["x"], ["sat"], 4)
    long = out.select("capture", "row", "line", F.posexplode(F.arrays_zip("x", "sat")).alias("band", "z"))
    return long.select("capture", "row", "line", "band", F.when(~F.isnan("z.x"), F.round("z.x", 6)).alias("x"), F.col("z.sat").alias("sat"))


@query(
    "same_board",
    """WITH p AS (SELECT c_nationkey AS capture, c_custkey AS board, c_acctbal::DOUBLE AS x, (c_custkey * 37 % 1000)::DOUBLE AS y, 40.0 * (1 + c_custkey % 5) AS reach FROM customer)
SELECT b.capture, b.board, CAST(count(a.board) AS BIGINT) AS near, CAST(count(a.board) FILTER (a.board < b.board) AS BIGINT) AS earlier, min(a.board) FILTER (a.board < b.board) AS first
FROM p b LEFT JOIN p a ON a.capture = b.capture AND a.board <> b.board AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < b.reach GROUP BY b.capture, b.board""",
)
def same_board(t):
    """How many boards lie within each board's reach, and the earliest before it."""
    p = t.customer.select(
        F.col("c_nationkey").alias("capture"), F.col("c_custkey").alias("board"), F.col("c_acctbal").cast("double").alias("x"),
        (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"), (F.lit(40.0) * (1 + F.col("c_custkey") % 5)).alias("reach"),
    )
    pairs = nearby.near_pairs(p, ["capture"], "board", "x", "y", "reach")
    before = F.col("a") < F.col("b")
    seen = pairs.groupBy("capture", F.col("b").alias("board")).agg(F.count(F.lit(1)).alias("near"), F.count_if(before).alias("earlier"), F.min(F.when(before, F.col("a"))).alias("first"))
    return p.select("capture", "board").join(seen, ["capture", "board"], "left").fillna(0, ["near", "earlier"])
