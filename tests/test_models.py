import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specloom.functions.pls import pls_path
from specloom.operators import folds as FO
from specloom.operators import metrics as M
from specloom.operators import models as ML
from specloom.operators import nested as NE


def gram(x, y):
    z = np.column_stack([x, y, np.ones(len(x))])
    return z.T @ z


def nipals(x, y, n):
    """Textbook PLS2 with deflation of the data itself."""
    xm, ym = x.mean(0), y.mean(0)
    e, f = x - xm, y - ym
    ws, ps, qs = [], [], []
    for _ in range(n):
        w = np.linalg.svd(e.T @ f)[0][:, 0]
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = (np.array(v).T for v in (ws, ps, qs))
    b = w @ np.linalg.solve(p.T @ w, q.T)
    return b, ym - xm @ b


def test_pls_matches_data_deflation_and_ols():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) + 3
    y = np.column_stack([x @ rng.normal(size=6) + rng.normal(size=80), rng.normal(size=80)])
    path = pls_path(gram(x, y), 6, [1, 2, 3, 6])
    for n in (1, 2, 3):
        b, b0 = nipals(x, y, n)
        assert np.allclose(path[n][0], b, atol=1e-8) and np.allclose(path[n][1], b0, atol=1e-7)
    ols = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), y, rcond=None)[0]
    assert np.allclose(path[6][0], ols[:-1], atol=1e-6)


def test_rank_limits_the_path():
    x = np.random.default_rng(1).normal(size=(30, 2)) @ np.ones((2, 5))
    assert max(pls_path(gram(x, x[:, :1]), 5, [1, 2, 3, 4])) == 1
    assert pls_path(np.zeros((8, 8)), 5, [1]) == {}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n, p = 600, 8
    dish = rng.integers(0, 20, n)
    y = (rng.random(n) < 0.6).astype(int)
    x = rng.normal(size=(n, p)) + np.outer(y, np.r_[1.2, -0.8, np.zeros(p - 2)]) + rng.normal(size=(20, p))[dish] * 0.3
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "dish": dish, "var": dish // 5, "y": y, "x": list(x)})), x, y, dish


def test_group_grams(rows):
    df, x, y, dish = rows
    got = ML.group_grams(df.withColumn("yy", F.array("y")), "dish", "x", "yy", 8, 1).toPandas()
    for d in (0, 7):
        m = np.stack(got[got["dish"] == d].sort_values("i")["v"])
        assert np.allclose(m, gram(x[dish == d], y[dish == d][:, None]))


def test_nested_cv_separates_and_permutation_does_not(rows):
    df, *_ = rows
    fold = FO.latin_square_folds(df, "dish", "var", "y", 4, 1).select("dish", "fold")
    sets = ML.label_sets(df, "id", "dish", "y", 2, 5)
    assert sets.where(F.size("ys") != 3).count() == 0
    oof, choices = ML.nested_cv(sets, "id", "dish", "var", {"x": ("x", 8)}, fold, grid=(1, 2, 4), n_sets=3, seed=1)
    assert oof.groupBy("set").count().toPandas()["count"].tolist() == [600] * 3
    auc = {r["set"]: r["auc"] for r in M.auc(oof, "y", "score", ["set"]).collect()}
    assert auc[0] > 0.8 and all(0.3 < auc[s] < 0.7 for s in (1, 2))
    assert choices.count() == 12
    # The held-out fold of a row is its group's fold.
    assert oof.where("set = 0").join(fold.withColumnRenamed("fold", "f"), "dish").where("f <> fold").count() == 0


def test_multiclass_discriminant(spark):
    rng = np.random.default_rng(3)
    n = 300
    lab, g = rng.integers(0, 3, n), rng.integers(0, 10, n)
    x = rng.normal(size=(n, 5)) + 4 * np.eye(5)[lab]
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "g": g, "s": g % 2, "lab": lab, "x": list(x)}))
    fold = FO.round_robin_folds(df, "g", "s", 5, 1).select("g", "fold")
    oof, _ = ML.plsda_cv(df, "id", "g", "lab", 3, "x", 5, fold, grid=(1, 2, 3))
    assert M.classification_summary(oof, "y", "pred", 3).first()["balanced_accuracy"] > 0.9


def test_class_weights_and_shuffled_labels(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    w = {r["cls"]: r["weight"] for r in ML.class_weights(df, "y", 2).collect()}
    assert w == {0: 4 / 6, 1: 2.0}
    g = spark.createDataFrame([(i, i % 3) for i in range(9)], "g int, y int")
    s = ML.shuffled_group_labels(g, "g", "y", 1).collect()
    assert sorted(r["y"] for r in s) == sorted(i % 3 for i in range(9)) and len({r["g"] for r in s}) == 9


def test_runs_fit_as_numpy_does_on_the_same_rows(spark, rows):
    """Three repeats and a permuted set in one plan: the folds of each repeat, one score a row and run,
    and scores, inner choices and cuts as from the data themselves."""
    df, x, y, dish = rows
    folds = NE.repeated_folds(df, "dish", "var", "y", 4, 3, 7).cache()
    for r in range(3):
        alone = FO.latin_square_folds(df, "dish", "var", "y", 4, 7 + r).select("dish", "fold")
        assert {tuple(t) for t in alone.collect()} == {(t["dish"], t["fold"]) for t in folds.where(F.col("repeat") == r).collect()}
    sets = ML.label_sets(df, "id", "dish", "y", 1, 5)
    parts = {"tail": [(4, 8)], "ends": [(0, 2), (6, 8)]}
    oof, choices = NE.nested_runs(sets, "id", "dish", "var", parts, folds, [(0, 0), (1, 0), (2, 0), (0, 1)], 4, 3, (1, 2), 7)
    got, chosen = oof.toPandas(), choices.toPandas()
    assert len(got) == 4 * 600 and not got.duplicated(["repeat", "set", "id"]).any() and len(chosen) == 16
    assert (chosen[chosen["set"] == 0]["rep"] == "ends").all()
    labels = {r["id"]: r["ys"] for r in sets.collect()}
    fold = {(t["repeat"], t["dish"]): t["fold"] for t in folds.collect()}
    for (r, s, k), part in got.groupby(["repeat", "set", "fold"]):
        truth = np.array([labels[i][s] for i in range(600)])
        out = np.array([fold[r, d] == k for d in dish])
        assert set(part["id"]) == set(np.flatnonzero(out)) and (part["y"].to_numpy() == truth[part["id"]]).all()
        use = np.concatenate([np.arange(a, b) for a, b in parts[part["rep"].iloc[0]]])
        b, b0 = nipals(x[~out][:, use], np.column_stack([1 - truth, truth])[~out], part["n"].iloc[0])
        score = x[part["id"].to_numpy()][:, use] @ (b[:, 1] - b[:, 0]) + b0[1] - b0[0]
        assert np.allclose(part["score"], score, atol=1e-8)
        assert ((part["score"] >= part["threshold"]) == (part["pred"] == 1)).all()


def test_runs_without_rows_or_choice(spark):
    kinds = "id int, dish int, var int, x array<double>, ys array<int>"
    folds = spark.createDataFrame([(0, d, d % 2) for d in range(4)], "repeat int, dish int, fold int")
    ask = lambda df: NE.nested_runs(df, "id", "dish", "var", {"x": [(0, 2)]}, folds, [(0, 0)], 2, 2, (1, 2), 1)
    assert ask(spark.createDataFrame([], kinds))[0].count() == 0
    # one class only: nothing to choose by, but every row keeps a score and a call
    one = spark.createDataFrame([(i, i % 4, 0, [float(i), 1.0], [1]) for i in range(16)], kinds)
    oof, choices = ask(one)
    got = oof.collect()
    assert len(got) == 16 and all(abs(r["score"] - 1) < 1e-9 and r["pred"] == 1 and r["threshold"] == 0.5 for r in got)
    assert all(r["inner_auc"] is None and r["n"] == 1 for r in choices.collect())


def test_packed_inner_scores_rank_as_rows_do(spark):
    """Ranges cut at good and bad places, ranges too large for a task, ties, one class only."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[:150] = x[0]  # one score for many rows
    ys = np.column_stack([rng.integers(0, 2, 400), np.ones(400, int)])
    data = [(i, i % 5, x[i].tolist(), ys[i].tolist()) for i in range(400)]
    rows = spark.createDataFrame(data, "id long, g int, x array<double>, ys array<int>")
    runs, slices = [(0, 0), (0, 1)], [np.arange(2), np.arange(1, 3)]
    places = spark.createDataFrame([(g, [(r, o, (g + o) % 2) for r in range(2) for o in range(3) if o != g % 3]) for g in range(5)], "g int, places array<struct<run: int, outer: int, inner: int>>")
    found = {(r, o, i, s): (np.array([0, 2, 4]), rng.normal(size=(2, 3)), rng.normal(size=3)) for r in range(2) for o in range(3) for i in range(2) for s in range(2)}
    about = {(r, o, s): {2: (0.0, 1.0, 400.0), 4: (0.0, 0.0 if s else 1e-3, 400.0)} for r in range(2) for o in range(3) for s in range(2)}
    fits = NE.Fits(slices, found, about)
    tried = NE.scored(rows, "id", "g", places, fits, runs).where("n > 0").withColumnRenamed("n", "comps")
    want = sorted(map(tuple, M.auc(tried, "y", "score", NE.PROBLEM).collect()))
    for most in (NE.RANGE_ROWS, 40, 7):
        assert sorted(map(tuple, NE.inner_aucs(rows, "g", places, fits, runs, most).collect())) == want
    packed = NE.packed_scores(rows, "g", places, fits, runs, 40)
    assert packed.count() < tried.count() / 4 and packed.agg({"n": "sum"}).first()[0] == tried.count()
    assert packed.select("range").distinct().count() > 5
