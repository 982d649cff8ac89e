import numpy as np
import pandas as pd
import pytest

from specloom.operators import metrics as M


def frame(spark, y, s, g=None):
    return spark.createDataFrame(
        pd.DataFrame({"id": range(len(y)), "y": y, "s": np.asarray(s, float), "g": g if g is not None else ["a"] * len(y)})
    )


def brute_auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)) if len(p) and len(q) else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 1200
    y = (rng.random(n) < 0.7).astype(int)
    s = np.round(rng.normal(y * 0.6, 1), 1)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcd"), n))
    y[g == "d"] = 1
    return y, s, g, frame(spark, y, s, g)


def test_literal_fixtures(spark):
    assert M.auc(frame(spark, [1, 0, 1, 0], [1, 1, 2, 0]), "y", "s").first()["auc"] == 0.875
    assert M.auc(frame(spark, [1, 1], [1, 2]), "y", "s").first()["auc"] is None
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int")
    assert M.balanced_accuracy(df, "y", "p", 3).first()[0] == 0.75


@pytest.mark.parametrize("n", [1, 9])
def test_auc_by_group(scored, n):
    y, s, g, df = scored
    got = {r["g"]: r["auc"] for r in M.auc(df, "y", "s", ["g"], n).collect()}
    for k in set(g):
        want = brute_auc(y[g == k], s[g == k])
        assert got[k] == want if want is None else abs(got[k] - want) < 1e-12
    w = M.within_group_auc(df, "y", "s", "g", n=n).first()
    pairs = {k: (y[g == k] == 1).sum() * (y[g == k] == 0).sum() for k in set(g)}
    want = sum(got[k] * p for k, p in pairs.items() if p) / sum(pairs.values())
    assert abs(w["within_auc"] - want) < 1e-12 and w["groups_used"] == sum(p > 0 for p in pairs.values())


@pytest.mark.parametrize("positive", [0, 1])
def test_average_precision_keeps_row_order_on_ties(scored, positive):
    y, s, _, df = scored
    hit = (y == positive).astype(int)
    order = np.argsort(-(s if positive == 1 else -s), kind="mergesort")
    h = hit[order]
    want = (np.cumsum(h) / np.arange(1, len(h) + 1) * h).sum() / h.sum()
    got = M.average_precision(df, "y", "s", "id", positive, n=8).first()["ap"]
    assert abs(got - want) < 1e-12


def test_roc_has_both_ends(scored):
    y, s, _, df = scored
    pts = M.roc_curve(df, "y", "s", "id", n=8).orderBy("step").toPandas()
    assert len(pts) == len(y) + 2
    assert tuple(pts.iloc[0][["fpr", "tpr"]]) == (0, 0) and tuple(pts.iloc[-1][["fpr", "tpr"]]) == (1, 1)
    assert pts["tpr"].is_monotonic_increasing


@pytest.mark.parametrize("n", [1, 9])
def test_best_threshold(spark, scored, n):
    y, s, g, df = scored
    got = {r["g"]: (r["threshold"], r["balanced_accuracy"]) for r in M.best_threshold(df, "y", "s", ["g"], n).collect()}
    for k in set(g):
        yy, ss = y[g == k], s[g == k]
        if len(set(yy)) < 2:
            assert got[k] == (np.median(ss), 0.5)
            continue
        u = np.unique(ss)
        cuts = np.r_[u[0] - 1, (u[:-1] + u[1:]) / 2, u[-1] + 1]
        ba = [((ss >= t)[yy == 1].mean() + (ss < t)[yy == 0].mean()) / 2 for t in cuts]
        assert abs(got[k][1] - max(ba)) < 1e-12
        assert abs(got[k][0] - cuts[int(np.argmax(np.round(ba, 12)))]) < 1e-9


def test_aggregate_scores(spark):
    rows = [("u", 1, [0.2, 0.8]), ("u", 1, [0.9, 0.1]), ("v", 0, [0.5, 0.5])]
    got = {r["k"]: r["y_pred"] for r in M.aggregate_scores(spark.createDataFrame(rows, "k string, y int, s array<double>"), "k", "y", "s", 2).collect()}
    assert got == {"u": 0, "v": 0}
    bad = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 0, [1.0, 0.0])], "k string, y int, s array<double>")
    with pytest.raises(Exception, match="conflicting labels"):
        M.aggregate_scores(bad, "k", "y", "s", 2).collect()
