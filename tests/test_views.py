import math

import pytest
from pyspark.sql import functions as F

from specloom.operators import collapse, folds, select, timing


def test_three_state_label(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    labels = spark.createDataFrame([("a", 2), ("b", None)], "k string, d int")
    got = {r["k"]: (r["scored"], r["label"]) for r in select.three_state(units, labels, "k", "d").collect()}
    assert got == {"a": (True, 1), "b": (True, 0), "c": (False, -1)}


def test_event_interval_literal(spark):
    visits = spark.createDataFrame([(1, [22.0, 48.0, 72.0, 96.0, 124.0])], "dish int, visits array<double>")
    units = spark.createDataFrame([(1, 1, True), (1, 3, True), (1, None, True), (1, None, False)], "dish int, day int, scored boolean")
    got = [(r["lower"], r["upper"]) for r in timing.event_interval(units, visits, "dish", "day", "scored").collect()]
    assert (0.0, 22.0) in got and (48.0, 72.0) in got and (124.0, math.inf) in got
    assert any(math.isnan(a) and math.isnan(b) for a, b in got)


def test_clock_defaults(spark):
    views = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    clock = spark.createDataFrame([(1, "t", 1.0, None), (2, "t", 2.0, "proxy_reflectance")], "k int, time string, hours double, source string")
    got = {r["k"]: (r["capture_hours"], r["capture_time_source"]) for r in timing.attach_clock(views, clock, ["k"]).collect()}
    assert got[1] == (1.0, "measured") and got[2] == (2.0, "proxy_reflectance")
    assert math.isnan(got[3][0]) and got[3][1] == "none"


def test_profile_returns_published_counts(spark):
    # Label counts per group, day1..day5 then never.
    counts = {"a": (36, 58, 5, 0, 1, 10), "b": (32, 49, 7, 3, 5, 13), "c": (29, 55, 6, 4, 2, 14), "d": (4, 74, 15, 5, 0, 11)}
    rows = [(g, d if d < 6 else None) for g, c in counts.items() for d, k in enumerate(c, 1) for _ in range(k)]
    df = spark.createDataFrame(rows, "g string, day int")
    got = {r["grp"]: r for r in timing.incidence_profile(df, "g", "day", [1, 2, 3, 4, 5]).collect()}
    a = got["all"]
    assert (a["n"], a["day1"], a["day2"], a["day3"], a["day4"], a["day5"], a["never"], a["germinated"]) == (438, 101, 236, 33, 12, 8, 48, 390)
    assert round(a["pct_germinated"], 1) == 89.0 and a["median_day"] == 2.0 and a["modal_day"] == 2
    assert round(got["a"]["pct_germinated"], 1) == 90.9 and got["d"]["modal_day"] == 2
    assert abs(a["cum_pct_day5"] - a["pct_germinated"]) < 1e-9


def test_latin_square_puts_one_group_of_each_stratum_in_each_fold(spark):
    rows = [(g, g // 5, int(i < g % 7)) for g in range(20) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, s int, y int")
    f = folds.latin_square_folds(df, "g", "s", "y", 5, 1)
    assert [r["count"] for r in f.groupBy("fold", "s").count().collect()] == [1] * 20
    assert folds.leakage(folds.attach_folds(df, f, "g"), "g").count() == 0
    rr = folds.round_robin_folds(df, "g", "s", 5, 1)
    assert [r["count"] for r in rr.groupBy("fold", "s").count().collect()] == [1] * 20


def test_group_spanning_strata_fails(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "g int, s int, y int")
    with pytest.raises(Exception, match="spans strata"):
        folds.round_robin_folds(df, "g", "s", 5, 1).collect()


def test_side_average_keeps_complete_units(spark):
    rows = [("k1", "r", [1.0, 2.0]), ("k1", "r", [3.0, 4.0]), ("k1", "t", [5.0, 6.0]), ("k2", "r", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, cell string, v array<double>")
    got = {r["cell"]: (r["v"], r["one_sided"]) for r in collapse.side_averaged(df, "k", ["cell"], "v", 2, 2).collect()}
    assert got == {"r": ([2.0, 3.0], False), "t": ([5.0, 6.0], True)}
    assert [r["k"] for r in collapse.dropped_units(df, "k", ["cell"], 2).collect()] == ["k2"]


def test_index_runs_text(spark):
    df = spark.createDataFrame([(1, i) for i in (0, 1, 2, 7, 8)], "k int, i int")
    assert select.format_runs(select.index_runs(df, ["k"], "i"), ["k"]).first()["runs"] == "0-2, 7-8"


def test_selection_and_class_ids(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 2), ("a", 0.9, 3)], "m string, nan double, v int")
    gate = select.selection(isin={"m": ["a"], "v": None}, at_most={"nan": 0.5, "v": None})
    assert [r["v"] for r in df.where(gate).collect()] == [1]
    ids = df.select(select.dense_class_id([3, 1], "v").alias("c")).collect()
    assert [r["c"] for r in ids] == [1, -1, 0]
    with pytest.raises(ValueError):
        select.restrict_classes("v", [1])


def test_top2_margin(spark):
    df = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 5.0), ("g", "c", 4.0), ("h", "z", 1.0)], "g string, i string, s double")
    got = {r["g"]: (r["best_id"], r["best"], r["margin"]) for r in select.top2_margin(df, ["g"], "s", "i").collect()}
    assert got == {"g": ("b", 5.0, 1.0), "h": ("z", 1.0, None)}


def test_stack_blocks_order(spark):
    df = spark.createDataFrame([("k", "t", [3.0]), ("k", "r", [1.0, 2.0])], "k string, cell string, v array<double>")
    assert collapse.stack_blocks(df, "k", "cell", "v", ["r", "t"]).first()["v"] == [1.0, 2.0, 3.0]
    assert df.where(F.lit(True)).count() == 2
