"""Rank and confusion metrics, pooled or within groups, as aggregate queries.

Every function takes column names and returns a DataFrame with one row per group
(``keys=[]`` pools everything into one row).  Scores are first counted per
distinct value, so ties and hot groups cost one row each before any ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cumulate, cumulate_rows, null_safe_join


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("bigint")


def score_counts(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; rows with any other label are left out."""
    return df.where(F.col(truth).isin(0, 1)).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        _count_if(F.col(truth) == 1).alias("pos"), _count_if(F.col(truth) == 0).alias("neg")
    )


def auc(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Mann-Whitney AUC with mid-ranks on ties; NULL where only one class occurs.

    Returns ``keys, n_pos, n_neg, auc``.
    """
    return counted_auc(score_counts(df, keys, truth, score), keys, n)


def counted_auc(counts: DataFrame, keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """The same from (keys, score, pos, neg), one row per distinct score."""
    out = counted_wins(counts, keys, n).withColumnsRenamed({"pos": "n_pos", "neg": "n_neg"})
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select(*keys, "n_pos", "n_neg", F.try_divide("wins", pairs).alias("auc"))


def counted_wins(counts: DataFrame, keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """(keys, pos, neg, wins): positives, negatives, and pairs in which the positive is above, ties half."""
    ranked = cumulate(counts, keys, "score", ["pos", "neg"], n)
    wins = F.col("pos").cast("double") * (
        F.col("neg_before").cast("double") + F.col("neg").cast("double") / F.lit(2.0)
    )
    return ranked.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(wins).alias("wins"))


def within_group_auc(
    df: DataFrame, truth: str, score: str, group: str, keys: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """AUC over pairs from the same group only, weighted by each group's pair count.

    Groups with one class hold no pair and drop out of the weighting.
    """
    per = auc(df, truth, score, [*keys, group], n)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return per.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(pairs > 0, F.col("auc") * pairs)), F.sum(F.when(pairs > 0, pairs))).alias(
            "within_auc"
        ),
        _count_if(pairs > 0).alias("groups_used"),
    )


def average_precision(
    df: DataFrame,
    truth: str,
    score: str,
    tiebreak: str,
    positive: int = 1,
    keys: Sequence[str] = (),
    n: int | None = None,
) -> DataFrame:
    """Average precision of one class; ties keep the order of ``tiebreak``.

    For class 0 the score is negated.  NULL when only one class occurs.
    """
    ascending = F.col(score).cast("double") * (-1.0 if positive == 1 else 1.0)
    rows = df.select(
        *keys,
        ascending.alias("__ask"),
        F.col(tiebreak).alias("__tiebreak"),
        (F.col(truth) == positive).cast("bigint").alias("hit"),
        F.lit(1).cast("bigint").alias("seen"),
    )
    run = cumulate_rows(rows, keys, "__ask", "__tiebreak", ["hit", "seen"], n)
    precision = (F.col("hit_before") + 1).cast("double") / (F.col("seen_before") + 1).cast("double")
    out = run.groupBy(*keys).agg(
        F.sum(F.when(F.col("hit") == 1, precision)).alias("__p"),
        F.sum("hit").alias("__hits"),
        F.sum("seen").alias("__n"),
    )
    return out.select(
        *keys,
        F.when(
            (F.col("__hits") > 0) & (F.col("__hits") < F.col("__n")),
            F.col("__p") / F.col("__hits").cast("double"),
        ).alias("ap"),
    )


def roc_curve(
    df: DataFrame, truth: str, score: str, tiebreak: str, keys: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """One point per row in descending score order, plus the (0,0) and (1,1) ends.

    Returns ``keys, step, fpr, tpr``; ``step`` 0 is the first end point.
    """
    rows = df.select(
        *keys,
        (-F.col(score).cast("double")).alias("__ask"),
        F.col(tiebreak).alias("__tiebreak"),
        (F.col(truth) == 1).cast("bigint").alias("tp"),
        (F.col(truth) == 0).cast("bigint").alias("fp"),
        F.lit(1).cast("bigint").alias("seen"),
    )
    run = cumulate_rows(rows, keys, "__ask", "__tiebreak", ["tp", "fp", "seen"], n)
    share = lambda m: (
        (F.col(f"{m}_before") + F.col(m)).cast("double") / F.greatest(F.col(f"{m}_total"), F.lit(1)).cast("double")
    )
    points = run.select(
        *keys, (F.col("seen_before") + 1).alias("step"), share("fp").alias("fpr"), share("tp").alias("tpr")
    )
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    zero, one = F.lit(0.0), F.lit(1.0)
    ends = size.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("step"), zero.alias("fpr"), zero.alias("tpr")),
                F.struct((F.col("__n") + 1).alias("step"), one.alias("fpr"), one.alias("tpr")),
            )
        ),
    )
    return points.unionByName(ends)


def best_threshold(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Cut with the highest balanced accuracy; the smallest such cut wins.

    Cuts lie midway between neighbouring distinct scores, one below the smallest and
    one above the largest.  With one class only: (median score, 0.5), the median read
    off the same ranked counts.
    """
    keys = list(keys)
    ranked = cumulate(score_counts(df, keys, truth, score), keys, "score", ["pos", "neg"], n)
    p, q = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    recall = lambda pos_above, neg_below: (
        F.try_divide(pos_above.cast("double"), p) + F.try_divide(neg_below.cast("double"), q)
    ) / F.lit(2.0)
    cut = F.coalesce((F.col("prev_value") + F.col("score")) / F.lit(2.0), F.col("score") - 1)
    rows, before = F.col("pos") + F.col("neg"), F.col("pos_before") + F.col("neg_before")
    everything = F.col("pos_total") + F.col("neg_total")
    holds = lambda i: (before <= i) & (i < before + rows)
    below = ranked.select(
        *keys,
        F.when(holds(F.floor((everything - 1) / 2)), F.col("score")).alias("__mid_lo"),
        F.when(holds(F.floor(everything / 2)), F.col("score")).alias("__mid_hi"),
        "pos_total",
        "neg_total",
        cut.alias("threshold"),
        recall(F.col("pos_total") - F.col("pos_before"), F.col("neg_before")).alias("ba"),
        "score",
    )
    best = below.groupBy(*keys).agg(
        F.max("pos_total").alias("pos_total"),
        F.max("neg_total").alias("neg_total"),
        F.min(F.when(F.col("ba").isNotNull(), F.struct((-F.col("ba")).alias("loss"), F.col("threshold")))).alias("b"),
        F.max("score").alias("top"),
        ((F.max("__mid_lo") + F.max("__mid_hi")) / F.lit(2.0)).alias("median"),
    )
    # The cut above every score calls everything negative: balanced accuracy 0.5.
    last = F.struct(F.lit(-0.5).alias("loss"), (F.col("top") + 1).alias("threshold"))
    pick = F.least(F.col("b"), last)
    both = (F.col("pos_total") > 0) & (F.col("neg_total") > 0)
    return best.select(
        *keys,
        F.when(both, pick["threshold"]).otherwise(F.col("median")).alias("threshold"),
        F.when(both, -pick["loss"]).otherwise(F.lit(0.5)).alias("balanced_accuracy"),
    )


def confusion(df: DataFrame, truth: str, pred: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (true class, predicted class), one zero-filled column per prediction."""
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("y_true"))
    counted = df.groupBy(*keys, F.col(truth).cast("int").alias("y_true")).agg(
        *[_count_if(F.col(pred) == c).alias(f"pred_{c}") for c in range(classes)]
    )
    if keys:
        return counted
    filled = [F.coalesce(F.col(f"pred_{c}"), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in range(classes)]
    return spine.join(counted, "y_true", "left").select("y_true", *filled)


def class_counts(df: DataFrame, truth: str, pred: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp and fn per class in one pass over the rows."""
    per = F.array(
        *[
            F.struct(
                F.lit(c).alias("cls"),
                _count_if((F.col(truth) == c) & (F.col(pred) == c)).alias("tp"),
                _count_if((F.col(truth) != c) & (F.col(pred) == c)).alias("fp"),
                _count_if((F.col(truth) == c) & (F.col(pred) != c)).alias("fn"),
            )
            for c in range(classes)
        ]
    )
    return df.groupBy(*keys).agg(per.alias("per"), F.count(F.lit(1)).alias("n")).select(
        *keys, "n", F.inline("per")
    )


def classification_summary(
    df: DataFrame, truth: str, pred: str, classes: int, keys: Sequence[str] = ()
) -> DataFrame:
    """n, accuracy (0 when empty), balanced accuracy over classes in the truth, macro F1."""
    c = class_counts(df, truth, pred, classes, keys)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    present = F.col("tp") + F.col("fn") > 0
    touched = F.col("tp") + F.col("fp") + F.col("fn") > 0
    out = c.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.max("n").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.avg(F.when(present, F.try_divide(tp, tp + fn))).alias("balanced_accuracy"),
        F.avg(F.when(touched, F.try_divide(2 * tp, 2 * tp + fp + fn))).alias("macro_f1"),
    )
    return out


def balanced_accuracy(df, truth, pred, classes, keys=()):
    return classification_summary(df, truth, pred, classes, keys).select(*keys, "balanced_accuracy")


def macro_f1(df, truth, pred, classes, keys=()):
    return classification_summary(df, truth, pred, classes, keys).select(*keys, "macro_f1")


def accuracy(df, truth, pred, keys=()):
    hit = (F.col(truth) == F.col(pred)).cast("double")
    return df.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def binary_summary(
    df: DataFrame,
    truth: str,
    score: str,
    tiebreak: str,
    threshold: float,
    pred: str | None = None,
    minority: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Prevalence, AUC, both average precisions and the hard-call metrics.

    Hard calls come from ``pred`` (each fold's own calls) when it is given, otherwise
    from ``score >= threshold``.  Ratios with an empty denominator are NULL.
    """
    keys = list(keys)
    call = F.col(pred) if pred else (F.col(score) >= F.lit(float(threshold))).cast("int")
    y = F.col(truth)
    hard = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y == 1).cast("double")).alias("prevalence"),
        F.avg((y == minority).cast("double")).alias("minority_prevalence"),
        F.avg((call == y).cast("double")).alias("accuracy"),
        _count_if((call == 1) & (y == 1)).alias("tp"),
        _count_if((call == 0) & (y == 0)).alias("tn"),
        _count_if((call == 1) & (y == 0)).alias("fp"),
        _count_if((call == 0) & (y == 1)).alias("fn"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    sens, spec = ratio("tp", "fn"), ratio("tn", "fp")
    hard = hard.select(
        "*",
        F.lit(float(threshold)).alias("threshold"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        ratio("tn", "fn").alias("precision_never"),
        F.coalesce((sens + spec) / F.lit(2.0), sens, spec).alias("balanced_accuracy"),
    )
    ranks = auc(df, truth, score, keys).select(*keys, "auc")
    ap1 = average_precision(df, truth, score, tiebreak, 1, keys).withColumnRenamed("ap", "ap_positive")
    ap0 = average_precision(df, truth, score, tiebreak, 0, keys).withColumnRenamed("ap", "ap_never")
    if keys:
        for part in (ranks, ap1, ap0):
            hard = null_safe_join(hard, part, keys, "left")
        return hard
    return hard.select("*", ranks.scalar().alias("auc"), ap1.scalar().alias("ap_positive"), ap0.scalar().alias("ap_never"))


def hardest_groups(df: DataFrame, truth: str, pred: str, group: str, k: int = 5) -> DataFrame:
    """The k groups with the lowest accuracy, ties by group: a report, so the limit is the feature."""
    return accuracy(df, truth, pred, [group]).orderBy("accuracy", group).limit(k)


def most_confused_pair(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The unordered pair of classes mistaken for each other most often."""
    wrong = df.where(F.col(truth) != F.col(pred))
    pairs = wrong.groupBy(
        F.least(F.col(truth), F.col(pred)).alias("class_a"), F.greatest(F.col(truth), F.col(pred)).alias("class_b")
    ).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("n"), "class_a", "class_b").limit(1)


def aggregate_scores(df: DataFrame, unit: str, truth: str, score: str, classes: int) -> DataFrame:
    """Average each unit's per-view score vectors and take the first best class.

    A unit whose views carry more than one truth fails the job.
    """
    mean = F.array(*[F.avg(F.get(F.col(score), F.lit(i))) for i in range(classes)])
    out = df.groupBy(unit).agg(
        F.min(truth).alias("y_true"), F.max(truth).alias("__y_max"), F.count(F.lit(1)).alias("views"), mean.alias("score")
    )
    checked = F.when(
        F.col("y_true").eqNullSafe(F.col("__y_max")), F.col("y_true")
    ).otherwise(F.raise_error(F.concat(F.lit("conflicting labels inside unit "), F.col(unit).cast("string"))))
    return out.select(
        unit,
        checked.alias("y_true"),
        "views",
        "score",
        (F.array_position("score", F.array_max("score")) - 1).cast("int").alias("y_pred"),
    )


def repeated_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread over repeats."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("repeats")
    )
