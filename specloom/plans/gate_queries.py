"""The data gate over all tables, plus sampling, occupancy and patch statistics."""

from pyspark.sql import functions as F

from ..operators import folds, gate, masks, patches, sampling
from ..operators.radiometry import percentile_stretch
from ..session import settle
from .mask_queries import COMPONENTS, RUNS, text_masks
from .registry import query, r6
from .view_queries import LATIN, SEED, hexkey, latin


@query(
    "data_gate",
    f"""WITH {LATIN}, {RUNS}, a AS (SELECT c_custkey, c_nationkey, fold FROM units JOIN latin USING (c_nationkey, region)),
v(name, violations) AS (
  SELECT 'row ids are 0..N-1', CASE WHEN min(c_custkey) = 0 AND max(c_custkey) = count(*) - 1 AND count(DISTINCT c_custkey) = count(*) THEN 0 ELSE 1 END FROM customer UNION ALL
  SELECT 'labels and labelled documents agree in number', abs((SELECT count(*) FROM labels) - (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))) UNION ALL
  SELECT 'every unit has its views', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <> 10)) UNION ALL
  SELECT 'known empty wells are absent', (SELECT count(*) FROM orders WHERE o_custkey IN (3, 6)) UNION ALL
  SELECT 'each group has one stratum', (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING min(n_regionkey) <> max(n_regionkey))) UNION ALL
  SELECT 'each unit has one priority', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderpriority) <> max(o_orderpriority))) UNION ALL
  SELECT 'status stays in its domain', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')) UNION ALL
  SELECT 'spectra are finite and complete', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) UNION ALL
  SELECT 'mask areas match their runs', (SELECT count(*) FROM (SELECT doc_id, sum(r1 - r0 + 1) AS a FROM seg GROUP BY 1) x
    FULL JOIN (SELECT doc_id, sum(n) AS b FROM spots WHERE pos % 2 = 1 GROUP BY 1 HAVING sum(n) > 0) y USING (doc_id) WHERE a IS DISTINCT FROM b) UNION ALL
  SELECT 'labels join to the index', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
  SELECT 'both outcomes occur', (SELECT CASE WHEN count(*) FILTER (quality = 1) > 0 AND count(*) FILTER (quality = 0) > 0 THEN 0 ELSE 1 END FROM labels) UNION ALL
  SELECT 'at least two groups are scored', (SELECT greatest(2 - count(DISTINCT lang), 0) FROM labels JOIN documents USING (doc_id)) UNION ALL
  SELECT 'no unit spans folds', (SELECT count(*) FROM (SELECT c_custkey FROM a GROUP BY 1 HAVING min(fold) <> max(fold))) UNION ALL
  SELECT 'no group spans folds', (SELECT count(*) FROM (SELECT c_nationkey FROM a GROUP BY 1 HAVING min(fold) <> max(fold)))
)
SELECT name, violations = 0 AS ok, CAST(violations AS BIGINT) AS violations FROM v""",
)
def data_gate(t):
    u, f = latin(t)
    a = folds.attach_folds(u, f, "c_nationkey")
    scored = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    m = text_masks(t)
    return gate.gate(
        gate.row_ids_dense(t.customer, "c_custkey"),
        gate.same_count(t.labels, t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi"), "labels and labelled documents agree in number"),
        gate.views_per_unit(t.orders, "o_custkey", 10),
        gate.absent(t.orders, "o_custkey", [3, 6]),
        gate.one_value_per_key(t.nation, "n_nationkey", "n_regionkey", "each group has one stratum"),
        gate.one_value_per_key(t.orders, "o_custkey", "o_orderpriority", "each unit has one priority"),
        gate.within_domain(t.orders, "o_orderstatus", ["F", "O", "P"], "status stays in its domain"),
        gate.spectra_finite(t.embeddings, "embedding", 64),
        gate.rle_matches(m, masks.decode_rle(m, ["doc_id"], "counts"), ["doc_id"], "counts"),
        gate.labels_join(t.labels, t.documents, "doc_id"),
        gate.both_classes(t.labels, "quality"),
        gate.several(scored, "lang", 2, "at least two groups are scored"),
        gate.no_leakage(a, "c_custkey", "no unit spans folds"),
        gate.no_leakage(a, "c_nationkey", "no group spans folds"),
    )


PLANTED = f"""{COMPONENTS},
cust AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, c_nationkey, c_custkey % 7 AS fold FROM customer),
ord AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders),
emb AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN embedding[1:63] ELSE embedding END AS v, embedding[1]::DOUBLE AS x0 FROM embeddings),
lab2 AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, 1 AS quality FROM labels),
box AS (SELECT doc_id, sum(r1 - r0 + 1) AS area, min(c) AS c_min, max(c) AS c_max, min(r0) AS r_min, max(r1) AS r_max FROM seg GROUP BY 1),
size AS (SELECT doc_id, len(text) // 40 + 1 AS w FROM documents),
v(name, violations) AS (
  SELECT 'row ids are 0..N-1', CASE WHEN min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) THEN 0 ELSE 1 END FROM cust UNION ALL
  SELECT 'row count matches the build record', abs((SELECT count(*) FROM orders) - 7) UNION ALL
  SELECT 'counts agree', abs((SELECT count(*) FROM lab2) - (SELECT count(*) FROM documents)) UNION ALL
  SELECT 'every unit has its views', (SELECT count(*) FROM (SELECT o_custkey FROM ord GROUP BY 1 HAVING count(*) <> 10)) UNION ALL
  SELECT 'known empty wells are absent', (SELECT count(*) FROM customer WHERE c_custkey IN (1, 2)) UNION ALL
  SELECT 'each group has one stratum', (SELECT count(*) FROM (SELECT c_nationkey FROM cust GROUP BY 1 HAVING min(fold) <> max(fold))) UNION ALL
  SELECT 'status stays in its domain', (SELECT count(*) FROM ord WHERE status NOT IN ('F', 'O', 'P')) UNION ALL
  SELECT 'spectra are finite and complete', (SELECT count(*) FROM emb WHERE len(v) <> 64) UNION ALL
  SELECT 'spectra are recomputed', (SELECT count(*) FROM emb WHERE vec_id % 11 = 0 AND x0 + 1 IS DISTINCT FROM x0) UNION ALL
  SELECT 'stored areas and boxes match the masks', (SELECT count(*) FROM box WHERE doc_id % 6 = 0) UNION ALL
  SELECT 'masks are one component', (SELECT count(*) FROM (SELECT doc_id FROM comp GROUP BY 1 HAVING count(*) > 1)) UNION ALL
  SELECT 'masks stay off the border', (SELECT count(*) FROM box JOIN size USING (doc_id) WHERE c_min <= 0 OR r_min <= 0 OR c_max >= w - 1 OR r_max >= 39) UNION ALL
  SELECT 'stored assignment matches a fresh one', (SELECT count(*) FROM documents WHERE doc_id % 8 = 0) UNION ALL
  SELECT 'labels join to the index', (SELECT count(*) FROM lab2 WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
  SELECT 'both outcomes occur', (SELECT CASE WHEN count(*) FILTER (quality = 1) > 0 AND count(*) FILTER (quality = 0) > 0 THEN 0 ELSE 1 END FROM lab2) UNION ALL
  SELECT 'more than one day', (SELECT greatest(2 - count(DISTINCT quality), 0) FROM lab2) UNION ALL
  SELECT 'no group spans folds', (SELECT count(*) FROM (SELECT c_nationkey FROM cust GROUP BY 1 HAVING min(fold) <> max(fold))) UNION ALL
  SELECT 'no fatal assignment problem', (SELECT count(*) FROM documents WHERE doc_id % 10 = 3)
)"""


@query("data_gate_planted", f"WITH RECURSIVE {PLANTED} SELECT name, violations = 0 AS ok, CAST(violations AS BIGINT) AS violations FROM v")
def data_gate_planted(t):
    """Every check on tables that were spoilt for it: none may pass."""
    cust = t.customer.select(F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("id"), "c_nationkey", (F.col("c_custkey") % 7).alias("fold"))
    orders = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    emb = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("v"), F.col("embedding")[0].cast("double").alias("x0"))
    labels = t.labels.select(F.when(F.col("doc_id") % 5 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.lit(1).alias("quality"))
    seg = masks.decode_rle(text_masks(t), ["doc_id"], "counts")
    size = t.documents.select("doc_id", F.lit(40).alias("h"), (F.floor(F.length("text") / 40) + 1).alias("w"))
    box = settle(masks.mask_box(seg, ["doc_id"]))
    spoilt = box.withColumn("area", F.col("area") + (F.col("doc_id") % 6 == 0).cast("bigint"))
    stored = t.documents.select("doc_id", (F.col("doc_id") % 22).alias("cell"))
    fresh = t.documents.select("doc_id", F.when(F.col("doc_id") % 8 == 0, -1).otherwise(F.col("doc_id") % 22).cast("bigint").alias("cell"))
    problems = t.documents.select(F.when(F.col("doc_id") % 10 == 3, "MASK_ERODED_AWAY").otherwise("CELL_WITHOUT_MASK").alias("problem"))
    return gate.gate(
        gate.row_ids_dense(cust, "id"),
        gate.row_count_is(t.orders, 7),
        gate.same_count(labels, t.documents, "counts agree"),
        gate.views_per_unit(orders, "o_custkey", 10),
        gate.absent(t.customer, "c_custkey", [1, 2]),
        gate.one_value_per_key(cust, "c_nationkey", "fold", "each group has one stratum"),
        gate.within_domain(orders, "status", ["F", "O", "P"], "status stays in its domain"),
        gate.spectra_finite(emb, "v", 64),
        gate.recomputed_equal(emb, emb.withColumn("x0", F.col("x0") + (F.col("vec_id") % 11 == 0).cast("int")), ["vec_id"], "x0", "spectra are recomputed"),
        gate.boxes_match(spoilt, box, ["doc_id"]),
        gate.single_component(masks.largest_gathered(masks.gather_rle(text_masks(t), ["doc_id"], "counts"), ["doc_id"])),
        gate.off_border(box.join(size, "doc_id"), "h", "w"),
        gate.recomputed_equal(stored, fresh, ["doc_id"], "cell", "stored assignment matches a fresh one"),
        gate.labels_join(labels, t.documents, "doc_id"),
        gate.both_classes(labels, "quality"),
        gate.more_than_one(labels, "quality", "more than one day"),
        gate.no_leakage(cust, "c_nationkey", "no group spans folds"),
        gate.no_fatal(problems),
    )


@query(
    "area_outliers",
    """WITH a AS (SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, area FROM a WHERE area < (SELECT quantile_cont(area, 0.005) FROM a) / 2 OR area > (SELECT quantile_cont(area, 0.995) FROM a) * 2""",
)
def area_outliers(t):
    boxes = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"))
    return gate.area_outliers(boxes, "area")


@query(
    "rederive_diff",
    """WITH s AS (SELECT o_custkey, min(o_orderdate) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
d AS (SELECT o_custkey, min(o_orderdate) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT o_custkey, s.v AS stored, d.v AS derived, CASE WHEN d.o_custkey IS NULL THEN 'only_stored' WHEN s.o_custkey IS NULL THEN 'only_derived' ELSE 'changed' END AS kind
FROM s FULL JOIN d USING (o_custkey) WHERE s.v IS DISTINCT FROM d.v""",
)
def rederive_diff(t):
    first = lambda drop: t.orders.where(F.col("o_orderstatus") != drop).groupBy("o_custkey").agg(F.min("o_orderdate").alias("v"))
    return masks.rederive_diff(first("P"), first("F"), ["o_custkey"], "v")


@query(
    "sample_per_group",
    f"""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {hexkey('doc_id')}) AS k FROM documents) WHERE k <= 25""",
)
def sample_per_group(t):
    return sampling.sample_per_group(t.documents.select("lang", "doc_id"), ["lang"], "doc_id", 25, SEED)


@query(
    "systematic_sample",
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % greatest((SELECT count(*) FROM customer) // 300, 1) = 0""",
)
def systematic_sample(t):
    return sampling.systematic_sample(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", 300)


@query("first_example", "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def first_example(t):
    return sampling.first_example(t.embeddings, "label", "vec_id", [])


@query(
    "flip_augment",
    f"""WITH p AS (SELECT vec_id, b, b // 8 AS py, b % 8 AS px, embedding[b + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS b)),
k AS (SELECT vec_id, {hexkey("('y' || vec_id)")} < 576460752303423488 AS fy, {hexkey("('x' || vec_id)")} < 576460752303423488 AS fx FROM embeddings)
SELECT vec_id, CAST(CASE WHEN fy THEN 7 - py ELSE py END AS INTEGER) AS py, CAST(CASE WHEN fx THEN 7 - px ELSE px END AS INTEGER) AS px, round(x, 6) AS x
FROM p JOIN k USING (vec_id)""",
)
def flip_augment(t):
    p = t.embeddings.select("vec_id", F.posexplode("embedding").alias("b", "x")).select(
        "vec_id", F.floor(F.col("b") / 8).cast("int").alias("py"), (F.col("b") % 8).alias("px"), r6(F.col("x").cast("double")).alias("x")
    )
    return sampling.flip_augment(p, "vec_id", 8, 8, SEED)


@query(
    "mask_mean_spectrum",
    """WITH p AS (SELECT label, embedding[1] > 0 AS inside, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS b FROM embeddings)
SELECT label, CAST(b AS INTEGER) AS band, round(avg(x) FILTER (x <= 0.15), 6) + 0.0 AS x FROM p WHERE inside GROUP BY 1, 2""",
)
def mask_mean_spectrum(t):
    """Values above 0.15 play invalid voxels; a band without any other stays, without a value."""
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.15, float("nan")).otherwise(x))
    p = t.embeddings.select("label", (F.col("embedding")[0] > 0).alias("inside"), holes.alias("v"))
    out = patches.mask_mean_spectrum(p, ["label"], "v", 64)
    return out.select("label", F.posexplode("spectrum").alias("band", "x")).select("label", "band", F.when(~F.isnan("x"), r6("x")).alias("x"))


GRAY = """cuts AS (SELECT lang, quantile_cont(n_chars, 0.01) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM documents GROUP BY lang),
g AS (SELECT lang, source, CAST(floor(greatest(0.0, least(1.0, (n_chars - lo) / greatest(hi - lo, 1e-9))) * 255) AS INTEGER) AS gray FROM documents JOIN cuts USING (lang))"""


@query(
    "otsu_occupancy",
    f"""WITH {GRAY}, h AS (SELECT lang, gray, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2),
r AS (SELECT lang, gray, sum(n) OVER w AS w0, sum(n * gray) OVER w AS m0, sum(n) OVER (PARTITION BY lang) AS w, sum(n * gray) OVER (PARTITION BY lang) AS m
      FROM h WINDOW w AS (PARTITION BY lang ORDER BY gray ROWS UNBOUNDED PRECEDING)),
s AS (SELECT lang, gray, coalesce(w0 * (w - w0) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)) / (w * w), 0) AS s FROM r),
c AS (SELECT lang, gray AS cut, row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, gray) AS k FROM s)
SELECT g.lang, source, round(avg((gray > cut)::INT::DOUBLE), 6) AS occupancy FROM g JOIN c ON c.lang = g.lang AND c.k = 1 GROUP BY 1, 2""",
)
def otsu_occupancy(t):
    """Lengths as gray levels between two percentiles of their language, so that long texts do not meet in one level."""
    gray = percentile_stretch(t.documents.select("lang", "source", "n_chars"), "n_chars", ["lang"])
    px = gray.select("lang", "source", "gray", F.lit("reflectance").alias("mode"), F.lit(0.0).alias("clip"))
    out = patches.occupancy(px, ["lang"], "source", "gray", "clip", "mode")
    return out.select("lang", "source", r6("occupancy").alias("occupancy"))
