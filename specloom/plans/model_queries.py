"""Cross-validated discriminants on the embedding spectra.

The vectors carry no plate, so 25 hashed groups of vectors play the dishes and their
number modulo 5 the stratum; folds hold out whole groups.
"""

from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import folds as FO
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import reports as RP
from ..session import settle
from . import evaluate as E
from .rank_queries import NEAREST, nearest_class
from .registry import query, r6, rounded

SEED = 20260817
P = 64


def spectra(t):
    v = t.embeddings.withColumn("grp", (FO.seeded_key("vec_id", SEED) % 25).cast("int"))
    return v.select("vec_id", "label", "grp", (F.col("grp") % 5).alias("stratum"), S.spectrum_pipeline("embedding", 0).alias("d0"), S.spectrum_pipeline("embedding", 1).alias("d1"))


def binary_rows(t):
    return spectra(t).withColumn("y", (F.col("label") < 5).cast("int"))


@query("plsda_cv")
def plsda_cv(t):
    """Ten-class discriminant: out-of-fold accuracy per outer fold and its component count."""
    rows = spectra(t)
    fold = settle(FO.round_robin_folds(rows, "grp", "stratum", 5, SEED).select("grp", "fold"))
    oof, choices = ML.plsda_cv(rows, "vec_id", "grp", "label", 10, "d0", P, fold)
    per = M.classification_summary(oof.withColumnRenamed("n", "components"), "y", "pred", 10, ["fold", "components"])
    return rounded(per, "accuracy", "balanced_accuracy", "macro_f1")


def run(t, repeats, vectors):
    rows = binary_rows(t)
    fold = settle(FO.latin_square_folds(rows, "grp", "stratum", "y", 5, SEED).select("grp", "fold"))
    sets = ML.label_sets(rows, "vec_id", "grp", "y", repeats, SEED) if repeats else rows.withColumn("ys", F.array("y"))
    return ML.nested_cv(sets, "vec_id", "grp", "stratum", vectors, fold, n_sets=repeats + 1, seed=SEED)


@query("nested_cv_predictions")
def nested_cv_predictions(t):
    """Out-of-fold score and hard call of every vector; representation and components are chosen inside."""
    oof, _ = run(t, 0, {"d0": ("d0", P), "d1": ("d1", P)})
    return oof.select("vec_id", "grp", "fold", "rep", "n", "y", r6("score").alias("score"), "pred")


@query("permutation_floor")
def permutation_floor(t):
    """AUC of the true labels, and mean and spread over the ten draws of labels moved between groups."""
    oof, _ = run(t, ML.PERMUTATIONS, {"d0": ("d0", P)})
    return rounded(ML.permutation_summary(M.auc(oof, "y", "score", ["set"])), "auc", "floor_mean", "floor_std")


@query(
    "class_weights",
    """SELECT label AS cls, CAST(count(*) AS BIGINT) AS n, round((SELECT count(*) FROM embeddings) / (10.0::DOUBLE * count(*)), 6) AS weight
FROM embeddings GROUP BY label""",
)
def class_weights(t):
    return rounded(ML.class_weights(t.embeddings, "label", 10), "weight")


@query(
    "permuted_label_sets",
    f"""WITH u AS (SELECT doc_id, lang, quality AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, sum(y) AS pos, count(*) AS n, rep FROM u, (SELECT unnest([1, 2]) AS rep) GROUP BY lang, rep),
tk AS (SELECT lang, rep, row_number() OVER (PARTITION BY rep ORDER BY CAST('0x' || substr(md5('{SEED}|' || rep || 't' || lang), 1, 15) AS BIGINT)) AS k FROM c),
gv AS (SELECT rep, pos, n, row_number() OVER (PARTITION BY rep ORDER BY CAST('0x' || substr(md5('{SEED}|' || rep || 'g' || lang), 1, 15) AS BIGINT)) AS k FROM c),
d AS (SELECT tk.lang, tk.rep, pos, n FROM tk JOIN gv USING (rep, k))
SELECT lang, rep, CAST(count(*) FILTER (CAST('0x' || substr(md5('{SEED}|draw' || rep || '|' || doc_id), 1, 15) AS BIGINT) % n < pos) AS BIGINT) AS positives,
  CAST(count(*) AS BIGINT) AS n FROM u JOIN d USING (lang) GROUP BY lang, rep""",
)
def permuted_label_sets(t):
    u = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    sets = ML.label_sets(u, "doc_id", "lang", "y", 2, SEED).select("lang", F.posexplode("ys").alias("rep", "y"))
    return sets.where("rep > 0").groupBy("lang", "rep").agg(
        F.sum(F.col("y").cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("n")
    )


MODES = [("reflectance", 0.0), ("reflectance", 8.0), ("transmittance", 0.0), ("transmittance", 8.0)]


def spectral_units(t):
    """Sixteen consecutive vectors make a unit, the signs of two bands the capture, and the unit's mean
    sixth band its outcome. Units that miss a capture take no part."""
    unit = F.floor(F.col("vec_id") / 16)
    views = t.embeddings.select(
        unit.alias("unit"), F.when(F.col("embedding")[1] < 0, "reflectance").otherwise("transmittance").alias("mode"),
        F.when(F.col("embedding")[0] < 0, 0.0).otherwise(8.0).alias("hours"), "embedding",
    )
    label = t.embeddings.groupBy(unit.alias("unit")).agg((F.avg(F.col("embedding")[5]) > 0).cast("int").alias("y"))
    blocks = E.unit_blocks(views, "unit", "embedding", P, MODES)
    whole = blocks.dropna(subset=[f"block_{i}" for i in range(len(MODES))])
    reps, parts = E.representations(whole, "unit", MODES, P, ML.FEATURE_SETS, [0, 1])
    rows = reps.join(label, "unit").withColumn("grp", (F.col("unit") % 20).cast("int"))
    return rows.withColumn("stratum", F.col("grp") % 4), parts


@query("evaluate_representations")
def evaluate_representations(t):
    """The whole evaluation over all fourteen representations, with five repeats and ten permuted label sets."""
    rows, parts = spectral_units(t)
    out = E.evaluate(rows, "unit", "grp", "stratum", "y", parts, repeats=5, permutations=ML.PERMUTATIONS, seed=SEED)
    return rounded(out, "value")


@query(
    "dataset_overview",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS views, CAST(count(DISTINCT o_custkey) AS BIGINT) AS units,
round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders GROUP BY o_orderstatus""",
)
def dataset_overview(t):
    return rounded(RP.dataset_overview(t.orders, "o_custkey", ["o_orderstatus"], "o_totalprice"), "median")


@query(
    "repeated_summary",
    """WITH r AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, CAST(count(m) AS BIGINT) AS repeats FROM r GROUP BY 1""",
)
def repeated_summary(t):
    per = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("m"))
    return rounded(M.repeated_summary(per, "m", ["l_returnflag"]), "mean", "std")


@query(
    "per_class_recall",
    f"""WITH {NEAREST}
SELECT CAST(g.c AS INTEGER) AS cls, CAST(count(*) FILTER (y = g.c) AS BIGINT) AS support,
  round(count(*) FILTER (y = g.c AND p = g.c)::DOUBLE / nullif(count(*) FILTER (y = g.c), 0), 6) AS recall,
  round(count(*) FILTER (y = g.c AND p = g.c)::DOUBLE / nullif(count(*) FILTER (p = g.c), 0), 6) AS precision
FROM v, (SELECT unnest(range(10)) AS c) g GROUP BY g.c""",
)
def per_class_recall(t):
    return rounded(RP.per_class_recall(nearest_class(t), "y", "p", 10), "recall", "precision")
