"""Masks, plate geometry and pose search over documents, customers and orders.

A document reads as a run-length mask: its words' lengths are the run lengths, drawn on
a frame 40 pixels high at a spot of the 4 x 7 plate that its id picks.  The source is
the capture.
"""

from pyspark.sql import functions as F

from ..operators import masks as K
from ..operators import plate as P
from .registry import query, r6

H, CELL_W = 40, 400

RUNS = """
words AS (SELECT doc_id, source, string_split(text, ' ') AS w FROM documents),
runs AS (
  SELECT doc_id, source, unnest(list_transform(w, lambda x: length(x))) AS n, generate_subscripts(w, 1) - 1 AS pos FROM words
), spots AS (
  SELECT doc_id, source, pos, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS s FROM runs
), fore AS (SELECT doc_id, source, s, s + n - 1 AS e FROM spots WHERE pos % 2 = 1 AND n > 0),
segs AS (
  SELECT doc_id, source, s, e, unnest(range(s // 40, e // 40 + 1)) AS c FROM fore
), seg AS (
  SELECT doc_id, source, c, CASE WHEN c = s // 40 THEN s % 40 ELSE 0 END AS r0, CASE WHEN c = e // 40 THEN e % 40 ELSE 39 END AS r1 FROM segs
)"""


def text_masks(t):
    counts = F.transform(F.split("text", " ", -1), F.length)
    return t.documents.select("doc_id", "source", F.lit(H).alias("h"), counts.alias("counts"))


@query(
    "rle_decode",
    f"""WITH {RUNS} SELECT doc_id, CAST(sum(r1 - r0 + 1) AS BIGINT) AS area, min(c) AS c_min, max(c) AS c_max,
CAST(min(r0) AS BIGINT) AS r_min, CAST(max(r1) AS BIGINT) AS r_max FROM seg GROUP BY doc_id""",
)
def rle_decode(t):
    return K.mask_box(K.decode_rle(text_masks(t), ["doc_id"], "counts"), ["doc_id"])


# Components by spreading the smallest number along touching segments until nothing changes.
COMPONENTS = f"""{RUNS}, node AS (SELECT row_number() OVER (ORDER BY doc_id, c, r0) AS id, * FROM seg),
edge AS (
  SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON a.doc_id = b.doc_id AND b.c IN (a.c, a.c + 1) AND a.id <> b.id
    AND b.r0 <= a.r1 + 1 AND b.r1 >= a.r0 - 1
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
lab(id, l) USING KEY (id) AS (
  SELECT id, id FROM node UNION
  SELECT e.b, min(lab.l) FROM lab JOIN both_ways e ON e.a = lab.id JOIN recurring.lab r ON r.id = e.b WHERE lab.l < r.l GROUP BY e.b
), comp AS (SELECT doc_id, l, sum(r1 - r0 + 1) AS px, min((r0, c)) AS first FROM node JOIN lab USING (id) GROUP BY 1, 2),
large AS (SELECT doc_id, arg_min(l, (-px, first)) AS l FROM comp GROUP BY doc_id)"""


@query(
    "largest_component",
    f"""WITH RECURSIVE {COMPONENTS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_components, CAST(sum(px) AS BIGINT) AS raw_px,
CAST(sum(px) - max(px) AS BIGINT) AS dropped_px FROM comp GROUP BY doc_id""",
)
def largest_component(t):
    """Components of every text mask: how many, and what the largest leaves out."""
    return K.largest_gathered(K.gather_rle(text_masks(t), ["doc_id"], "counts"), ["doc_id"]).select("doc_id", *K.COUNTS)


@query(
    "erode",
    f"""WITH {RUNS},
px AS (SELECT DISTINCT doc_id, c, unnest(range(r0, r1 + 1)) AS r FROM seg),
w AS (SELECT doc_id, len(text) // 40 + 1 AS w FROM documents),
near AS (SELECT p.doc_id, p.c + d.dc AS c, p.r + d.dr AS r FROM px p, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) d(dc, dr)),
need AS (
  SELECT p.doc_id, p.c, p.r, 1 + (p.r < 39)::INT + (p.r > 0)::INT + (p.c > 0)::INT + (p.c < w - 1)::INT AS k FROM px p JOIN w USING (doc_id)
), got AS (SELECT doc_id, c, r, count(*) AS k FROM near GROUP BY 1, 2, 3)
SELECT doc_id, CAST(count(*) AS BIGINT) AS area FROM need JOIN got USING (doc_id, c, r) WHERE need.k = got.k GROUP BY doc_id""",
)
def erode(t):
    m = text_masks(t)
    size = t.documents.select("doc_id", F.lit(H).cast("bigint").alias("h"), (F.floor(F.length("text") / H) + 1).alias("w"))
    left = K.erode_gathered(K.gather_rle(m, ["doc_id"], "counts"), ["doc_id"], 1, size)
    rows = F.aggregate(F.zip_with("r0", "r1", lambda a, b: b - a + 1), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return left.select("doc_id", rows.alias("area"))


ASSIGN = f"""{COMPONENTS}, big AS (SELECT node.* FROM node JOIN lab USING (id) JOIN large USING (doc_id, l)),
cell(r, c, lab) AS (
  SELECT r, c, CASE WHEN r IN (0, 3) AND c IN (0, 6) THEN 200 WHEN (r = 3 AND c = 3) OR (r = 2 AND c = 6) THEN 100
    ELSE CAST(sum(CASE WHEN (r IN (0, 3) AND c IN (0, 6)) OR (r = 3 AND c = 3) OR (r = 2 AND c = 6) THEN 0 ELSE 1 END)
         OVER (ORDER BY r * 7 + c ROWS UNBOUNDED PRECEDING) AS INTEGER) END
  FROM (SELECT unnest(range(4)) AS r) a, (SELECT unnest(range(7)) AS c) b
), hits AS (
  SELECT s.source, s.doc_id, cell.lab, sum(r1 - r0 + 1) AS px FROM big s
  JOIN cell ON cell.r = s.doc_id % 4 AND cell.c = least((s.c + 400 * (s.doc_id // 4 % 7)) // 400, 6)
  WHERE s.c + 400 * (s.doc_id // 4 % 7) <= 2800 GROUP BY 1, 2, 3
), tot AS (SELECT doc_id, sum(r1 - r0 + 1) AS npx FROM big GROUP BY doc_id),
best AS (SELECT doc_id, arg_min(lab, (-px, lab)) AS lab, max(px) AS px FROM hits WHERE lab < 100 GROUP BY doc_id),
judged AS (
  SELECT d.source, d.doc_id, b.lab, t.npx, b.px / t.npx::DOUBLE AS containment,
    CASE WHEN t.npx IS NULL THEN 'EMPTY_MASK' WHEN b.lab IS NULL THEN 'MASK_OFF_LATTICE'
         WHEN b.px / t.npx::DOUBLE < 0.5 THEN 'MASK_STRADDLES_CELLS' END AS problem
  FROM documents d LEFT JOIN tot t USING (doc_id) LEFT JOIN best b USING (doc_id)
), claim AS (SELECT source, lab, min(doc_id) AS m FROM judged WHERE problem IS NULL GROUP BY 1, 2)"""


def placed(t):
    """Largest components of text masks, moved to the plate spot their id picks, with the fitted plate's labels."""
    spot_r, spot_c = F.col("doc_id") % 4, F.floor(F.col("doc_id") / 4) % 7
    keys = ["source", "doc_id"]
    whole = K.prepare_gathered(K.gather_rle(text_masks(t), keys, "counts"), keys, 0, t.documents)
    seg = K.spread(whole, keys).select(
        "source", "doc_id", (F.col("c") + spot_c * CELL_W).alias("c"),
        (F.col("r0") + spot_r * H).alias("r0"), (F.col("r1") + spot_r * H).alias("r1"),
    )
    frames = t.documents.select("source").distinct().select(
        "source",
        F.array(F.lit(CELL_W / 2), F.lit(H / 2)).alias("origin"),
        F.array(F.lit(float(CELL_W)), F.lit(0.0)).alias("e_col"),
        F.array(F.lit(0.0), F.lit(float(H))).alias("e_row"),
    )
    cells = P.cells_from_frame(frames, ["source"]).select(
        "source", "row", "col", "corners",
        F.when(F.col("kind") == "kernel", F.col("index") + 1)
        .when(F.col("kind") == "marker", K.MARKER_LABEL).otherwise(K.RIM_LABEL).alias("label"),
        (F.col("row") * 7 + F.col("col")).alias("ord"), F.lit(4 * H).alias("h"), F.lit(7 * CELL_W + 1).alias("w"),
    )
    labels = K.cell_labels(K.quad_segments(cells, ["source"], "h", "w"), ["source"], "label", "ord")
    captures = t.documents.select("source").distinct().select(
        "source", F.lit(4 * H).alias("h"), F.lit(7 * CELL_W + 1).alias("w"), F.lit("pass").alias("status"),
        F.sequence(F.lit(1), F.lit(22)).alias("wells"),
    )
    drawn = t.documents.select("source", "doc_id", F.lit(4 * H).alias("h"), F.lit(7 * CELL_W + 1).alias("w"))
    return K.assign(drawn, seg, labels, captures, ["source"], "doc_id", "doc_id")


@query(
    "overlap_assign",
    f"""WITH RECURSIVE {ASSIGN} SELECT j.source, doc_id, CAST(j.lab - 1 AS INTEGER) AS cell_index, round(containment, 6) AS containment,
CAST(npx AS BIGINT) AS npx FROM judged j JOIN claim c ON c.source = j.source AND c.lab = j.lab AND c.m = j.doc_id WHERE problem IS NULL""",
)
def overlap_assign(t):
    rows, _ = placed(t)
    return rows.select("source", "doc_id", "cell_index", r6("containment").alias("containment"), "npx")


@query(
    "assign_problems",
    f"""WITH RECURSIVE {ASSIGN}, wells AS (SELECT source, CAST(w AS INTEGER) AS lab FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(1, 23)) AS w))
SELECT source, problem, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT source, problem FROM judged WHERE problem IS NOT NULL UNION ALL
  SELECT j.source, 'TWO_MASKS_ONE_CELL' FROM judged j JOIN claim c ON c.source = j.source AND c.lab = j.lab WHERE problem IS NULL AND c.m <> doc_id UNION ALL
  SELECT w.source, 'CELL_WITHOUT_MASK' FROM wells w LEFT JOIN claim c ON c.source = w.source AND c.lab = w.lab WHERE c.lab IS NULL
) GROUP BY 1, 2""",
)
def assign_problems(t):
    _, problems = placed(t)
    return problems.groupBy("source", "problem").agg(F.count(F.lit(1)).alias("n"))
