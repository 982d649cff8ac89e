"""Rank, confusion and threshold metrics over documents scored by length.

The three-state label is ``labels.quality``: 1, 0, or no row at all (never scored).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import dot
from ..operators import metrics as M
from ..operators.collapse import mean_vector
from .registry import Tables, query, r6, rounded

SCORED = """
scored AS (
  SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS y,
         CASE WHEN d.n_chars >= 1500 THEN 1 ELSE 0 END AS p
  FROM documents d JOIN labels l USING (doc_id)
)"""


def scored(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(
        t.labels.select("doc_id", "quality"), "doc_id"
    ).select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("score"),
        F.col("quality").alias("y"),
        (F.col("n_chars") >= 1500).cast("int").alias("p"),
    )


def auc_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    also = f"PARTITION BY {keys}, score" if keys else "PARTITION BY score"
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
ranked AS (
  SELECT {lead}y, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({also}) - 1) / 2.0::DOUBLE AS r FROM scored
), sums AS (
  SELECT {lead}CAST(count(*) FILTER (y = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (y = 0) AS BIGINT) AS n_neg,
         sum(CASE WHEN y = 1 THEN r END) AS s FROM ranked {group}
), aucs AS (
  SELECT {lead}n_pos, n_neg,
         (s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos::DOUBLE * n_neg, 0) AS auc FROM sums
)"""


@query("pooled_auc", f"WITH {SCORED}, {auc_sql('')} SELECT n_pos, n_neg, round(auc, 6) AS auc FROM aucs")
def pooled_auc(t):
    return rounded(M.auc(scored(t), "y", "score"), "auc")


@query(
    "per_group_auc",
    f"WITH {SCORED}, {auc_sql('source')} SELECT source, n_pos, n_neg, round(auc, 6) AS auc FROM aucs",
)
def per_group_auc(t):
    return rounded(M.auc(scored(t), "y", "score", ["source"]), "auc")


@query(
    "within_group_auc",
    f"""WITH {SCORED}, {auc_sql('lang')},
parts AS (
  SELECT grouping_label AS lang, n_pos, n_neg, auc, within_auc FROM (
    SELECT lang AS grouping_label, n_pos, n_neg, auc, NULL::DOUBLE AS within_auc FROM aucs
    UNION ALL
    SELECT '(within)', CAST(sum(n_pos) AS BIGINT), CAST(sum(n_neg) AS BIGINT), NULL,
           sum(auc * n_pos * n_neg) / sum(CASE WHEN auc IS NOT NULL THEN n_pos * n_neg END) FROM aucs)
)
SELECT lang, n_pos, n_neg, round(auc, 6) AS auc, round(within_auc, 6) AS within_auc FROM parts""",
)
def within_group_auc(t):
    """Flagship: one row per language and one for pairs inside a language only."""
    per = M.auc(scored(t), "y", "score", ["lang"])
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    both = per.rollup("lang").agg(
        F.grouping("lang").alias("pool"),
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        F.max("auc").alias("auc"),
        F.try_divide(F.sum(F.col("auc") * pairs), F.sum(F.when(pairs > 0, pairs))).alias("within_auc"),
    )
    pool = F.col("pool") == 1
    rows = both.select(
        F.when(pool, "(within)").otherwise(F.col("lang")).alias("lang"),
        "n_pos",
        "n_neg",
        F.when(~pool, F.col("auc")).alias("auc"),
        F.when(pool, F.col("within_auc")).alias("within_auc"),
    )
    return rounded(rows, "auc", "within_auc")


@query(
    "within_group_auc_by_source",
    f"""WITH {SCORED}, {auc_sql('source')}
SELECT round(sum(auc * n_pos * n_neg) / sum(CASE WHEN auc IS NOT NULL THEN n_pos * n_neg END), 6) AS within_auc,
       CAST(count(auc) AS BIGINT) AS groups_used FROM aucs""",
)
def within_group_auc_by_source(t):
    return rounded(M.within_group_auc(scored(t), "y", "score", "source"), "within_auc")


def ap_sql(direction: str, cls: int) -> str:
    return f"""WITH {SCORED}, run AS (
  SELECT lang, y, sum(CASE WHEN y = {cls} THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS k
  FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score {direction}, doc_id ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT lang, sum(CASE WHEN y = {cls} THEN tp::DOUBLE / k END) AS s,
         count(*) FILTER (y = {cls}) AS hits, count(*) AS n FROM run GROUP BY lang
)
SELECT lang, CASE WHEN hits > 0 AND hits < n THEN round(s / hits, 6) END AS ap FROM ends"""


@query("average_precision", ap_sql("DESC", 1))
def average_precision(t):
    return rounded(M.average_precision(scored(t), "y", "score", "doc_id", 1, ["lang"]), "ap")


@query("average_precision_minority", ap_sql("ASC", 0))
def average_precision_minority(t):
    return rounded(M.average_precision(scored(t), "y", "score", "doc_id", 0, ["lang"]), "ap")


@query(
    "roc_curve",
    f"""WITH {SCORED}, run AS (
  SELECT lang, row_number() OVER w AS step,
         sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER w AS fp, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER w AS tp,
         sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS fn,
         sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS tn
  FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)
)
SELECT lang, CAST(step AS BIGINT) AS step, round(fp::DOUBLE / greatest(fn, 1), 6) AS fpr,
       round(tp::DOUBLE / greatest(tn, 1), 6) AS tpr FROM run
UNION ALL SELECT lang, 0, 0.0, 0.0 FROM scored GROUP BY lang
UNION ALL SELECT lang, CAST(count(*) + 1 AS BIGINT), 1.0, 1.0 FROM scored GROUP BY lang""",
)
def roc_curve(t):
    return rounded(M.roc_curve(scored(t), "y", "score", "doc_id", ["lang"]), "fpr", "tpr")


THRESHOLD = """
by_score AS (
  SELECT lang, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY lang, score
), cuts AS (
  SELECT lang, coalesce((score + lag(score) OVER w) / 2.0::DOUBLE, score - 1) AS t,
         sum(pos) OVER (PARTITION BY lang) - (sum(pos) OVER w - pos) AS tp, sum(neg) OVER w - neg AS tn,
         sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS q
  FROM by_score WINDOW w AS (PARTITION BY lang ORDER BY score)
  UNION ALL
  SELECT lang, max(score) + 1, 0, sum(neg), sum(pos), sum(neg) FROM by_score GROUP BY lang
), best AS (
  SELECT lang, t, p, q, (tp::DOUBLE / nullif(p, 0) + tn::DOUBLE / nullif(q, 0)) / 2.0::DOUBLE AS ba,
         row_number() OVER (PARTITION BY lang
            ORDER BY (tp::DOUBLE / nullif(p, 0) + tn::DOUBLE / nullif(q, 0)) / 2.0::DOUBLE DESC, t) AS k
  FROM cuts
)"""


@query(
    "best_threshold",
    f"""WITH {SCORED}, {THRESHOLD}
SELECT lang, CASE WHEN p = 0 OR q = 0 THEN (SELECT quantile_cont(s.score, 0.5) FROM scored s WHERE s.lang = best.lang) ELSE round(t, 6) END AS threshold,
  CASE WHEN p = 0 OR q = 0 THEN 0.5::DOUBLE ELSE round(ba, 6) END AS balanced_accuracy FROM best WHERE k = 1""",
)
def best_threshold(t):
    return rounded(M.best_threshold(scored(t), "y", "score", ["lang"]), "threshold", "balanced_accuracy")


@query(
    "confusion",
    f"""WITH {SCORED}
SELECT CAST(g.c AS INTEGER) AS y_true, CAST(count(y) FILTER (p = 0) AS BIGINT) AS pred_0,
       CAST(count(y) FILTER (p = 1) AS BIGINT) AS pred_1
FROM (VALUES (0), (1)) g(c) LEFT JOIN scored ON y = g.c GROUP BY g.c""",
)
def confusion(t):
    return M.confusion(scored(t), "y", "p", 2)


SUMMARY = f"""WITH {SCORED}, classes AS (SELECT * FROM (VALUES (0), (1)) g(c)),
counts AS (
  SELECT lang, c, count(*) AS n, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp,
         count(*) FILTER (y = c AND p <> c) AS fn FROM scored CROSS JOIN classes GROUP BY lang, c
)
SELECT lang, CAST(max(n) AS BIGINT) AS n, round(sum(tp)::DOUBLE / max(n), 6) AS accuracy,
       round(avg(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END), 6) AS balanced_accuracy,
       round(avg(CASE WHEN tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) END), 6) AS macro_f1
FROM counts GROUP BY lang"""


@query("classification_summary", SUMMARY)
def classification_summary(t):
    return rounded(
        M.classification_summary(scored(t), "y", "p", 2, ["lang"]), "accuracy", "balanced_accuracy", "macro_f1"
    )


@query("balanced_accuracy", f"SELECT lang, balanced_accuracy FROM ({SUMMARY})")
def balanced_accuracy(t):
    return rounded(M.balanced_accuracy(scored(t), "y", "p", 2, ["lang"]), "balanced_accuracy")


@query("macro_f1", f"SELECT lang, macro_f1 FROM ({SUMMARY})")
def macro_f1(t):
    return rounded(M.macro_f1(scored(t), "y", "p", 2, ["lang"]), "macro_f1")


@query(
    "binary_summary",
    f"""WITH {SCORED}, {auc_sql('')},
hard AS (
  SELECT count(*) AS n, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg,
         count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 0 AND y = 0) AS tn,
         count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn FROM scored
), down AS (
  SELECT y, sum(y) OVER w AS tp, row_number() OVER w AS k FROM scored
  WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)
), up AS (
  SELECT y, sum(1 - y) OVER w AS tp, row_number() OVER w AS k FROM scored
  WINDOW w AS (ORDER BY score, doc_id ROWS UNBOUNDED PRECEDING)
)
SELECT CAST(n AS BIGINT) AS n, round(pos::DOUBLE / n, 6) AS prevalence, round(neg::DOUBLE / n, 6) AS minority_prevalence,
       round((tp + tn)::DOUBLE / n, 6) AS accuracy, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, 1500.0::DOUBLE AS threshold,
       round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
       round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS precision_never,
       round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2.0::DOUBLE, 6) AS balanced_accuracy,
       (SELECT round(auc, 6) FROM aucs) AS auc,
       (SELECT round(sum(CASE WHEN y = 1 THEN tp::DOUBLE / k END) / sum(y), 6) FROM down) AS ap_positive,
       (SELECT round(sum(CASE WHEN y = 0 THEN tp::DOUBLE / k END) / sum(1 - y), 6) FROM up) AS ap_never
FROM hard""",
)
def binary_summary(t):
    out = M.binary_summary(scored(t), "y", "score", "doc_id", 1500.0)
    floats = [f.name for f in out.schema if f.dataType.typeName() == "double" and f.name != "threshold"]
    return rounded(out, *floats)


@query(
    "hardest_groups",
    f"""WITH {SCORED}
SELECT source, avg((y = p)::INT::DOUBLE).round(6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM scored
GROUP BY source ORDER BY avg((y = p)::INT::DOUBLE), source LIMIT 5""",
)
def hardest_groups(t):
    return rounded(M.hardest_groups(scored(t), "y", "p", "source"), "accuracy")


# Every vector goes to the class whose mean vector has the largest inner product with it,
# rounded so that both engines break near ties alike.
NEAREST = """x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS band, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label AS cls, band, avg(x) AS m FROM x GROUP BY 1, 2),
near AS (SELECT vec_id, x.label AS y, cls, round(sum(x * m), 9) AS s FROM x JOIN mean USING (band) GROUP BY 1, 2, 3),
v AS (SELECT vec_id, y, arg_min(cls, (-s, cls)) AS p FROM near GROUP BY 1, 2)"""


def nearest_class(t):
    """(y, p) of every vector, scored from all its entries."""
    size = 64
    means = t.embeddings.groupBy("label").agg(mean_vector("embedding", size).alias("m"))
    table = means.agg(F.array_sort(F.collect_list(F.struct("label", "m")))).scalar()  # one entry a class
    score = F.transform("__m", lambda c: F.struct(-F.round(dot(F.col("embedding").cast("array<double>"), c["m"]), 9), c["label"].alias("cls")))
    return t.embeddings.withColumn("__m", table).select(F.col("label").cast("int").alias("y"), F.array_min(score)["cls"].cast("int").alias("p"))


@query(
    "most_confused_pair",
    f"""WITH {NEAREST}
SELECT CAST(least(y, p) AS INTEGER) AS class_a, CAST(greatest(y, p) AS INTEGER) AS class_b, CAST(count(*) AS BIGINT) AS n
FROM v WHERE y <> p GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1""",
)
def most_confused_pair(t):
    return M.most_confused_pair(nearest_class(t), "y", "p")


@query(
    "top2_margin",
    f"""WITH {SCORED}, rates AS (
  SELECT lang, source, avg(y::DOUBLE) AS rate FROM scored GROUP BY lang, source
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rate DESC, source) AS k FROM rates
)
SELECT lang, max(CASE WHEN k = 1 THEN source END) AS best_source, round(max(CASE WHEN k = 1 THEN rate END), 6) AS best,
       round(max(CASE WHEN k = 1 THEN rate END) - max(CASE WHEN k = 2 THEN rate END), 6) AS margin
FROM k GROUP BY lang""",
)
def top2_margin(t):
    from ..operators.select import top2_margin as top2

    rates = scored(t).groupBy("lang", "source").agg(F.avg(F.col("y").cast("double")).alias("rate"))
    out = top2(rates, ["lang"], "rate", "source")
    return out.select("lang", F.col("best_id").alias("best_source"), r6("best").alias("best"), r6("margin").alias("margin"))
