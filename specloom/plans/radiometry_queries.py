"""Radiometric correction over the embedding table read as a line-scan cube.

``label`` plays the spatial row, ``vec_id`` the scan line and the 64 entries the
bands, scaled to camera counts.  Lines with a negative first band serve as dark
lines, the others as white lines.
"""

from pyspark.sql import functions as F

from ..operators import radiometry as R
from ..operators.interpolate import clamp_interpolate
from ..operators.ordered import exact_percentiles
from ..operators.timing import micros
from ..session import settle
from .registry import query, r6, rounded

BANDS = 64


def counts(t, gain, lift):
    """(row, line, c): counts floor((x + lift) * gain)."""
    c = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((x + lift) * gain).cast("double"))
    return t.embeddings.select(F.col("label").alias("row"), F.col("vec_id").alias("line"), c.alias("c"), F.col("embedding")[0].alias("e0"))


def dark_frame(t):
    lines = counts(t, 200.0, 1.0).where("e0 < 0")
    return R.reference_frame(lines, ["row"], "c", BANDS, "median", "dark")


def white_frame(t):
    lines = counts(t, 1000.0, 2.0).where("e0 >= 0")
    return R.reference_frame(lines, ["row"], "c", BANDS, "median", "white")


def validity(t):
    """The calibration set, computed once per query: one row per sensor cell."""
    return settle(R.white_validity(dark_frame(t), white_frame(t), "row", 0.93, 1.08))


def frames(t):
    return R.calibration(validity(t), "row")


LONG = """
long AS (SELECT vec_id AS line, label AS row, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS band,
         embedding[1] AS e0 FROM embeddings),
dark AS (SELECT row, band, quantile_cont(floor((x + 1.0) * 200.0), 0.5) AS dark FROM long WHERE e0 < 0 GROUP BY row, band),
white AS (SELECT row, band, quantile_cont(floor((x + 2.0) * 1000.0), 0.5) AS white FROM long WHERE e0 >= 0 GROUP BY row, band)"""
VALID = f"""{LONG},
cells AS (
  SELECT row, band, white AS w, dark > 1.08 * (SELECT quantile_cont(dark, 0.5) FROM dark) AS hot,
         quantile_cont(white, 0.5) OVER (PARTITION BY band) AS typical FROM white JOIN dark USING (row, band)
), ok AS (SELECT row, band, w, w >= 100 AND w >= 0.15 * typical AND NOT hot AS cell_valid FROM cells),
levels AS (SELECT band, coalesce(quantile_cont(w, 0.5) FILTER (cell_valid), 0.0) AS band_level FROM ok GROUP BY band),
kept AS (SELECT band, band_level, band_level >= 0.93 * (SELECT max(band_level) FROM levels) AS band_kept FROM levels),
validity AS (SELECT row, band, w, cell_valid, cell_valid AND band_kept AS valid, band_level, band_kept FROM ok JOIN kept USING (band))"""
TRANS = f"""{VALID},
cube AS (SELECT row, line, band, floor((x + 1.0) * 2000.0) AS c FROM long),
trans AS (
  SELECT row, line, band, CASE WHEN valid THEN (c - dark) / white * 0.5 ELSE 'NaN'::DOUBLE END AS t
  FROM cube JOIN dark USING (row, band) JOIN white USING (row, band) JOIN validity USING (row, band)
)"""


@query(
    "reference_median",
    f"WITH {LONG} SELECT row, CAST(band AS INTEGER) AS band, round(dark, 6) AS x FROM dark",
)
def reference_median(t):
    return dark_frame(t).select("row", F.posexplode("dark").alias("band", "x")).select("row", "band", r6("x").alias("x"))


@query(
    "reference_mean",
    f"""WITH {LONG} SELECT row, CAST(band AS INTEGER) AS band, round(avg(floor((x + 1.0) * 200.0)), 6) AS x
FROM long WHERE e0 < 0 GROUP BY row, band""",
)
def reference_mean(t):
    frame = R.reference_frame(counts(t, 200.0, 1.0).where("e0 < 0"), ["row"], "c", BANDS, "mean", "m")
    return frame.select("row", F.posexplode("m").alias("band", "x")).select("row", "band", r6("x").alias("x"))


@query(
    "hot_pixels",
    f"""WITH {LONG} SELECT row, CAST(band AS INTEGER) AS band, dark > 1.08 * (SELECT quantile_cont(dark, 0.5) FROM dark) AS hot FROM dark""",
)
def hot_pixels(t):
    return R.hot_pixels(dark_frame(t), "row", "dark", 1.08).select("row", F.posexplode("hot").alias("band", "hot"))


@query(
    "white_validity",
    f"WITH {VALID} SELECT row, CAST(band AS INTEGER) AS band, w, cell_valid, valid, round(band_level, 6) AS band_level, band_kept FROM validity",
)
def white_validity(t):
    return rounded(validity(t).drop("dark", "hot"), "band_level")


@query(
    "white_summary",
    f"""WITH {VALID}, b AS (SELECT band, max(band_level) AS l, bool_or(band_kept) AS k FROM validity GROUP BY band),
r AS (SELECT row, bool_or(valid) AS alive FROM validity GROUP BY row)
SELECT (SELECT CAST(band AS INTEGER) FROM b ORDER BY l DESC, band LIMIT 1) AS peak_band,
  (SELECT CAST(count(*) FILTER (k) AS BIGINT) FROM b) AS bands_kept,
  (SELECT CAST(count(*) FILTER (NOT k) AS BIGINT) FROM b) AS bands_dropped,
  (SELECT CAST(count(*) FILTER (NOT alive) AS BIGINT) FROM r) AS dead_rows,
  (SELECT round(avg((NOT valid)::INT::DOUBLE), 6) FROM validity) AS invalid_frac""",
)
def white_summary(t):
    return rounded(R.white_summary(validity(t), "row"), "invalid_frac")


@query(
    "white_gain_noise",
    f"""WITH {VALID}, sd AS (SELECT row, band, stddev_pop(floor((x + 2.0) * 1000.0)) AS sd, count(*) AS n FROM long WHERE e0 >= 0 GROUP BY row, band),
rel AS (SELECT sd / sqrt(n) / greatest(w, 1.0) * 100 AS rel FROM sd JOIN validity USING (row, band) WHERE valid)
SELECT CAST(count(*) AS BIGINT) AS n, round(quantile_cont(rel, 0.5), 6) AS median_pct, round(quantile_cont(rel, 0.99), 6) AS p99_pct FROM rel""",
)
def white_gain_noise(t):
    lines = counts(t, 1000.0, 2.0).where("e0 >= 0")
    return rounded(R.white_gain_noise(lines, "row", "c", BANDS, validity(t)), "median_pct", "p99_pct")


def corrected(t, cells=None):
    cube = counts(t, 2000.0, 1.0).drop("e0")
    return R.transmittance(cube, R.calibration(cells or validity(t), "row"), "row", "c", 0.5)


@query(
    "transmittance",
    f"WITH {TRANS} SELECT row, line, CAST(band AS INTEGER) AS band, CASE WHEN NOT isnan(t) THEN round(t, 6) + 0.0 END AS x FROM trans",
)
def transmittance(t):
    """Every cell; invalid ones stay, without a value."""
    out = R.long_bands(corrected(t), "t", "row", "line")
    return out.select("row", "line", "band", F.when(~F.isnan("x"), r6("x")).alias("x"))


@query(
    "fill_bad_cells",
    f"""WITH {TRANS}, near AS (
  SELECT b.row, b.band, g.row AS src_row, g.band AS src_band FROM validity b JOIN validity g
    ON g.valid AND abs(g.row - b.row) <= 1 AND abs(g.band - b.band) <= 1 WHERE NOT b.valid AND b.band_kept
), enough AS (SELECT row, band FROM near GROUP BY row, band HAVING count(*) >= 4),
fixed AS (
  SELECT n.row, g.line, n.band, avg(g.t) AS t FROM near n JOIN enough USING (row, band)
  JOIN trans g ON g.row = n.src_row AND g.band = n.src_band GROUP BY n.row, g.line, n.band
)
SELECT t.row, t.line, CAST(t.band AS INTEGER) AS band, round(coalesce(f.t, t.t), 6) + 0.0 AS x, f.t IS NOT NULL AS filled
FROM trans t LEFT JOIN fixed f ON f.row = t.row AND f.line = t.line AND f.band = t.band""",
)
def fill_bad_cells(t):
    """Every cell of every line after filling; cells without enough good neighbours stay invalid."""
    v = validity(t)
    src = R.fill_sources(v, "row")
    filled = R.long_bands(R.fill_bad_cells(corrected(t, v), src, "row", "line", "t"), "t", "row", "line")
    done = src.select("row", "band").distinct().withColumn("filled", F.lit(True))
    out = filled.join(done, ["row", "band"], "left")
    return rounded(out.select("row", "line", "band", "x", F.coalesce("filled", F.lit(False)).alias("filled")), "x")


@query(
    "reflectance",
    f"""WITH {LONG} SELECT row, line, CAST(band AS INTEGER) AS band,
  round(floor(greatest(floor((x + 1.0) * 2000.0) - dark, 0)) / white, 6) + 0.0 AS x
FROM long JOIN dark USING (row, band) JOIN white USING (row, band)""",
)
def reflectance(t):
    cube = counts(t, 2000.0, 1.0).drop("e0")
    out = R.white_correct(R.dark_subtract(cube, dark_frame(t), "row", "c"), white_frame(t), "row", "c")
    return rounded(R.long_bands(out, "r", "row", "line"), "x")


@query(
    "band_mean",
    f"""WITH {TRANS} SELECT row, line, round(coalesce(avg(t) FILTER (NOT isnan(t)), 'NaN'::DOUBLE), 6) + 0.0 AS band_mean,
  round(avg((c >= 2300)::INT::DOUBLE), 6) AS clip_frac FROM trans JOIN cube USING (row, line, band) GROUP BY row, line""",
)
def band_mean(t):
    cube = corrected(t).withColumn("clip", F.transform("c", lambda x: x >= 2300))
    out = R.band_mean(cube, "t", None, "clip")
    return rounded(out.select("row", "line", "band_mean", "clip_frac"), "band_mean", "clip_frac")


@query(
    "open_beam_check",
    f"""WITH {VALID}, v AS (
  SELECT row, band, floor((x + 1.0) * 3300.0) AS c, (floor((x + 1.0) * 3300.0) - dark) / white * 0.5 AS t, cell_valid
  FROM long JOIN dark USING (row, band) JOIN white USING (row, band) JOIN validity USING (row, band)
), clip AS (SELECT band, avg((c >= 4095)::INT::DOUBLE) AS clip_frac FROM v GROUP BY band),
rows AS (SELECT band, count(*) FILTER (cell_valid) AS valid_rows FROM validity GROUP BY band),
cand AS (SELECT v.* FROM v JOIN clip USING (band) JOIN rows USING (band) WHERE cell_valid AND clip_frac <= 0.01 AND valid_rows >= 4),
cut AS (SELECT band, quantile_cont(c, 0.9) AS cut FROM cand GROUP BY band),
med AS (SELECT band, quantile_cont(t, 0.5) AS m FROM cand JOIN cut USING (band) WHERE c >= cut GROUP BY band)
SELECT CAST(band AS INTEGER) AS band, round(clip_frac, 6) AS clip_frac, CAST(valid_rows AS BIGINT) AS valid_rows,
  round(m, 6) AS median_t FROM clip JOIN rows USING (band) LEFT JOIN med USING (band)""",
)
def open_beam_check(t):
    cube = counts(t, 3300.0, 1.0).drop("e0")
    return rounded(R.open_beam_check(cube, "row", "c", frames(t), 0.5, 4), "clip_frac", "median_t")


TAPE = "tape AS (SELECT label AS row, vec_id AS line FROM embeddings WHERE embedding[2] >= 0.03)"


def tape(t):
    return t.embeddings.where(F.col("embedding")[1] >= F.lit(0.03).cast("float")).select(
        F.col("label").alias("row"), F.col("vec_id").alias("line")
    )


@query(
    "tape_white",
    f"""WITH {LONG}, {TAPE.replace('0.03', '0.03::FLOAT')}, k AS (SELECT row, count(*) AS k FROM tape GROUP BY row),
trusted AS (SELECT row FROM k WHERE k >= 0.97 * (SELECT quantile_cont(k, 0.5) FROM k)),
known AS (SELECT row, band, quantile_cont(floor((x + 1.0) * 2000.0), 0.75) AS w FROM long JOIN tape USING (row, line)
          WHERE row IN (SELECT row FROM trusted) GROUP BY row, band),
spine AS (SELECT DISTINCT row, band FROM long),
lo AS (SELECT s.row, s.band, max(k.row) AS r0 FROM spine s JOIN known k ON k.band = s.band AND k.row <= s.row GROUP BY 1, 2),
hi AS (SELECT s.row, s.band, min(k.row) AS r1 FROM spine s JOIN known k ON k.band = s.band AND k.row >= s.row GROUP BY 1, 2)
SELECT s.row, CAST(s.band AS INTEGER) AS band, round(CASE WHEN a.w IS NULL THEN b.w WHEN b.w IS NULL OR r0 = r1 THEN a.w
  ELSE a.w + (b.w - a.w) * (s.row - r0)::DOUBLE / (r1 - r0) END, 6) AS white
FROM spine s LEFT JOIN lo ON lo.row = s.row AND lo.band = s.band LEFT JOIN hi ON hi.row = s.row AND hi.band = s.band
LEFT JOIN known a ON a.row = r0 AND a.band = s.band LEFT JOIN known b ON b.row = r1 AND b.band = s.band""",
)
def tape_white(t):
    cube = counts(t, 2000.0, 1.0)
    known = R.tape_white(cube, "row", "line", "c", tape(t), 0.75, 0.97)
    rows = cube.select("row").distinct()
    spine = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return rounded(clamp_interpolate(spine, known, ["band"], "row", "white"), "white")


@query(
    "tape_saturation",
    f"""WITH {LONG}, {TAPE.replace('0.03', '0.03::FLOAT')}, per AS (
  SELECT t.row IS NOT NULL AS on_tape, band, avg((floor((x + 1.0) * 2000.0) >= 2500)::INT::DOUBLE) AS s
  FROM long l LEFT JOIN tape t ON t.row = l.row AND t.line = l.line GROUP BY 1, 2
)
SELECT on_tape, round(avg(s), 6) AS clip_frac, CAST(first(band ORDER BY s DESC, band) AS INTEGER) AS peak_band,
  round(max(s), 6) AS peak_frac, CAST(count(*) FILTER (s > 0.01) AS INTEGER) AS hot_bands FROM per GROUP BY on_tape""",
)
def tape_saturation(t):
    clip = counts(t, 2000.0, 1.0).withColumn("clip", F.transform("c", lambda x: x >= 2500))
    out = R.tape_saturation(clip, "row", "line", "clip", BANDS, tape(t))
    return rounded(out, "clip_frac", "peak_frac")


@query(
    "tape_span",
    f"WITH {TAPE.replace('0.03', '0.03::FLOAT')} SELECT min(line) AS first_line, max(line) AS last_line FROM tape",
)
def tape_span(t):
    return R.tape_span(tape(t), "line")


@query(
    "unphysical_share",
    f"""WITH {TRANS} SELECT round(avg((t > 0.5)::INT::DOUBLE), 6) AS above, avg((t > 0.5)::INT::DOUBLE) > 0.001 AS warn
FROM trans WHERE NOT isnan(t)""",
)
def unphysical_share(t):
    doubled = corrected(t).withColumn("t", F.transform("t", lambda x: x * 2))
    out = R.unphysical_share(doubled, "t")
    return out.select(r6("above_one").alias("above"), "warn")


@query(
    "line_period",
    """WITH g AS (SELECT event_type, epoch_us(ts) AS us,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts))::DOUBLE AS gap FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS lines, round(quantile_cont(gap, 0.5), 6) AS period FROM g GROUP BY event_type""",
)
def line_period(t):
    us = t.events.select("event_type", micros("ts").alias("us"))
    return rounded(R.line_period(us, ["event_type"], "us"), "period")


MONTHLY = """grid AS (
  SELECT l_returnflag, l_linenumber, month(l_shipdate) - 1 AS m, avg(l_extendedprice) AS p, avg(l_quantity) AS q,
         bool_or(l_extendedprice > 104500) AS s FROM lineitem GROUP BY 1, 2, 3
)"""


def monthly(t):
    return t.lineitem.groupBy("l_returnflag", "l_linenumber", (F.month("l_shipdate") - 1).cast("bigint").alias("m")).agg(
        F.array(F.avg("l_extendedprice"), F.avg("l_quantity")).alias("v"),
        F.array(F.bool_or(F.col("l_extendedprice") > 104500)).alias("s"),
    )


SHRINK = """w AS (
  SELECT o.o, s.s, least((o.o + 1) * 12.0::DOUBLE / 7, s.s + 1) - greatest(o.o * 12.0::DOUBLE / 7, s.s) AS w
  FROM (SELECT unnest(range(7)) AS o) o, (SELECT unnest(range(12)) AS s) s
  WHERE least((o.o + 1) * 12.0::DOUBLE / 7, s.s + 1) - greatest(o.o * 12.0::DOUBLE / 7, s.s) > 1e-9
)"""
GROW = """c AS (
  SELECT o, greatest(0.0, least(11.0, (o + 0.5) * 12.0::DOUBLE / 18 - 0.5)) AS pos FROM (SELECT unnest(range(18)) AS o)
), w AS (
  SELECT o, floor(pos) AS s, 1 - (pos - floor(pos)) AS w FROM c UNION ALL
  SELECT o, least(floor(pos) + 1, 11), pos - floor(pos) FROM c
)"""


def resample_sql(weights):
    return f"""WITH {MONTHLY}, {weights} SELECT l_returnflag, l_linenumber, CAST(w.o AS BIGINT) AS m,
  round(sum(p * w.w) / sum(w.w), 6) AS price, round(sum(q * w.w) / sum(w.w), 6) AS qty
FROM grid JOIN w ON w.s = grid.m WHERE w.w > 0 GROUP BY 1, 2, 3"""


def resampled(t, factor):
    weights = R.axis_weights(t.spark, 12, factor)
    out = R.resample_axis(monthly(t), "m", ["l_returnflag", "l_linenumber"], "v", 2, weights)
    return out.select(
        "l_returnflag", "l_linenumber", "m", r6(F.col("v")[0]).alias("price"), r6(F.col("v")[1]).alias("qty")
    )


@query("resample_shrink", resample_sql(SHRINK))
def resample_shrink(t):
    return resampled(t, 0.6)


@query("resample_grow", resample_sql(GROW))
def resample_grow(t):
    return resampled(t, 1.5)


@query(
    "resample_mask",
    f"""WITH {MONTHLY}, {SHRINK} SELECT l_returnflag, l_linenumber, CAST(w.o AS BIGINT) AS m, bool_or(s) AS hit
FROM grid JOIN w ON w.s = grid.m GROUP BY 1, 2, 3""".replace("bool_or(s) AS hit", "bool_or(grid.s) AS hit"),
)
def resample_mask(t):
    weights = R.axis_weights(t.spark, 12, 0.6)
    out = R.resample_mask(monthly(t), "m", ["l_returnflag", "l_linenumber"], "s", 1, weights)
    return out.select("l_returnflag", "l_linenumber", "m", F.col("s")[0].alias("hit"))


@query(
    "clamp_interpolate",
    """WITH daily AS (SELECT o_orderstatus, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS d, sum(o_totalprice) AS rev, count(*) AS n
  FROM orders GROUP BY 1, 2),
known AS (SELECT * FROM daily WHERE n >= 4),
near AS (SELECT s.o_orderstatus, s.d, (SELECT max(k.d) FROM known k WHERE k.o_orderstatus = s.o_orderstatus AND k.d <= s.d) AS d0,
  (SELECT min(k.d) FROM known k WHERE k.o_orderstatus = s.o_orderstatus AND k.d >= s.d) AS d1 FROM daily s)
SELECT n.o_orderstatus, CAST(n.d AS INTEGER) AS d, round(CASE WHEN a.rev IS NULL THEN b.rev WHEN b.rev IS NULL OR d0 = d1 THEN a.rev
  ELSE a.rev + (b.rev - a.rev) * (n.d - d0)::DOUBLE / (d1 - d0) END, 6) AS rev
FROM near n LEFT JOIN known a ON a.o_orderstatus = n.o_orderstatus AND a.d = d0
LEFT JOIN known b ON b.o_orderstatus = n.o_orderstatus AND b.d = d1""",
)
def interpolate(t):
    daily = t.orders.groupBy("o_orderstatus", F.unix_date(F.to_date("o_orderdate")).alias("d")).agg(
        F.sum("o_totalprice").alias("rev"), F.count(F.lit(1)).alias("n")
    )
    known = daily.where("n >= 4").select("o_orderstatus", "d", "rev")
    out = clamp_interpolate(daily.select("o_orderstatus", "d"), known, ["o_orderstatus"], "d", "rev")
    return rounded(out, "rev")


@query(
    "white_percentile",
    """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
FROM lineitem GROUP BY 1, 2""",
)
def white_percentile(t):
    out = exact_percentiles(
        t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": 0.5, "p75": 0.75, "p99": 0.99}
    )
    return rounded(out, "p50", "p75", "p99")


@query(
    "percentile_stretch",
    """WITH c AS (SELECT lang, quantile_cont(n_chars, 0.01) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM documents GROUP BY lang)
SELECT doc_id, CAST(floor(greatest(0.0, least(1.0, (n_chars - lo) / greatest(hi - lo, 1e-9))) * 255) AS INTEGER) AS gray
FROM documents JOIN c USING (lang)""",
)
def percentile_stretch(t):
    out = R.percentile_stretch(t.documents.select("doc_id", "lang", "n_chars"), "n_chars", ["lang"])
    return out.select("doc_id", "gray")
