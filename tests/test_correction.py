"""Calibration resolution, correction plans and resampling against numpy; near points against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.operators import calibration as C
from specloom.operators import nearby
from specloom.operators import radiometry as R
from specloom.plans import correction as P

CATALOG = "kind string, day int, folder string"


def test_a_days_own_capture_takes_the_shared_ones_place(spark):
    catalog = spark.createDataFrame(
        [("dark_sample", None, "dark_sample/60k"), ("dark_white", None, "dark_white/2100"), ("white", None, "white/2100"), ("white", 3, "day3/white/2k"),
         ("white", 4, "day4/white/one"), ("dark_sample", 5, "a/60k"), ("dark_sample", 5, "b/60k"), ("dark", 1, "day1/dark/x")], CATALOG)
    days = spark.createDataFrame([(d,) for d in (1, 1, 3, 4, 5)], "day int")
    got = {r.day: r for r in C.transmittance_bundle(catalog, days).collect()}
    assert len(got) == 4
    assert (got[1].white, got[1].white_scope, got[1].t_long, got[1].t_short, got[1].problem) == ("white/2100", "shared", 60000.0, 2100.0, None)
    assert math.isclose(got[1].k, 0.035) and not got[1].exposures_differ
    assert (got[3].white, got[3].white_scope, got[3].exposures_differ) == ("day3/white/2k", "day-specific", True) and math.isclose(got[3].k, 2 / 60)
    assert got[4].problem == "no exposure in white" and got[4].k is None
    assert got[5].problem == "more than one dark_sample"
    fixed = {r.day: r for r in C.transmittance_bundle(catalog, days, 50000, 1000).collect()}
    assert fixed[4].problem is None and math.isclose(fixed[4].k, 0.02)
    assert {r.day: r.problem for r in C.reflectance_bundle(catalog, days).collect()} == {1: None, 3: "no dark", 4: "no dark", 5: "no dark"}


def lines_of(name, a, keys=("capture",)):
    """Rows (name, row, line, values) of an array (row, line, band)."""
    return [(name, r, n, a[r, n].astype(float).tolist()) for r in range(a.shape[0]) for n in range(a.shape[1])]


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(7)
    size = (6, 9, 8)
    cal = {"dark_sample/50k": rng.normal(200, 5, size), "dark_white/2k": rng.normal(90, 4, size), "white/2k": rng.normal(2500, 90, size)}
    cal["dark_sample/50k"][2, :, 3] = 900  # a hot cell
    cal["white/2k"][:, :, 7] = 300  # a dim band
    cal["white/2k"][4, :, :] = 110  # a dead row
    cal["white/2k"][0, :, 0] = 60  # at the edge of the frame
    for a in cal.values():
        np.round(a, out=a)
    cal["white/2k"][:, 8, :] = 0  # a blank line
    raw = np.round(rng.normal(2000, 400, (6, 10, 8)))
    raw[1, 4, 2] = 4095
    return cal, raw


def test_transmittance_plan(spark, scene):
    cal, raw = scene
    catalog = spark.createDataFrame([(k.split("/")[0], None, k) for k in cal], CATALOG)
    captures = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.7), ("c", 2, 1.0)], "capture string, day int, factor double")
    catalog = catalog.unionByName(spark.createDataFrame([("white", 2, "x"), ("white", 2, "y")], CATALOG))
    lines = spark.createDataFrame([row for k, a in cal.items() for row in lines_of(k, a)], "folder string, row int, line int, c array<double>")
    cube = spark.createDataFrame([row for k in "abc" for row in lines_of(k, raw)], "capture string, row int, line int, c array<double>")
    bundle = C.transmittance_bundle(catalog, captures)
    cells = C.reference_cells(lines, bundle, "row", "c")
    done = P.correct_transmittance(cube, captures, bundle, cells, 8, min_rows=2)

    med = {k: np.median(np.where((a == 0).all(2)[..., None], np.nan, a)[:, : 8 if k == "white/2k" else 9], axis=1) for k, a in cal.items()}
    dark, w = med["dark_sample/50k"], med["white/2k"] - med["dark_white/2k"]
    hot = dark > 3 * np.median(dark)
    ok = (w >= 100) & (w >= 0.15 * np.median(w, axis=0)) & ~hot
    level = np.array([np.median(w[ok[:, b], b]) if ok[:, b].any() else 0 for b in range(8)])
    kept = level >= 0.5 * level.max()
    valid = ok & kept
    assert hot[2, 3] and not kept[7] and not valid[4].any() and not valid[0, 0]
    want = np.where(valid[:, None, :], (raw - dark[:, None]) / w[:, None] * 0.04, np.nan)
    filled = want.copy()
    for r, b in zip(*np.nonzero(~valid & kept), strict=True):
        near = [(i, j) for i in range(max(0, r - 1), min(6, r + 2)) for j in range(max(0, b - 1), min(8, b + 2)) if (i, j) != (r, b) and valid[i, j]]
        if len(near) >= 4:
            filled[r, :, b] = np.mean([want[i, :, j] for i, j in near], axis=0)
    assert np.isfinite(filled[2, 0, 3]) and np.isfinite(filled[4, 0, 4]) and np.isnan(filled[0, 0, 0])
    got = {(r.capture, r.row, r.line): r for r in done.cube.collect()}
    assert {k[0] for k in got} == {"a", "b"}
    assert np.allclose([[got["a", r, n].t for n in range(10)] for r in range(6)], filled, equal_nan=True)
    assert {k for k in got if k[0] == "a" and got[k].sat[2]} == {("a", 1, 4)}
    step = 10 / 7  # seven lines from ten
    weights = np.array([[max(0, min((o + 1) * step, s + 1) - max(o * step, s)) for s in range(10)] for o in range(7)])
    short = np.einsum("os,rsb->rob", weights / weights.sum(1, keepdims=True), filled)
    assert np.allclose([[got["b", r, n].t for n in range(7)] for r in range(6)], short, equal_nan=True)
    assert {k[2] for k in got if k[0] == "b" and got[k].sat[2]} == {o for o in range(7) if weights[o, 4] > 1e-9}

    quality = {r.capture: r for r in done.quality.collect()}
    q, good = quality["a"], valid[:, None, :] & ~(raw >= 4095) & np.isfinite(filled)
    assert quality["c"].problem == "more than one white" and quality["c"].p1 is None and quality["c"].lines == 10
    assert np.allclose([q.p1, q.median, q.p99], np.percentile(filled[good], [1, 50, 99])) and math.isclose(q.saturated_frac, 1 / raw.size)
    assert math.isclose(q.valid_unsaturated_frac, good.mean()) and q.above_one == 0 and not q.unphysical and q.hot_cells == hot.sum()
    plane = np.array([[np.nanmean(filled[r, n, kept]) for n in range(10)] for r in range(6)])
    assert np.allclose([q.stretch_lo, q.stretch_hi], 10 ** np.percentile(np.log10(plane), [0.5, 99.5]))
    assert math.isclose(q.fully_in_range_frac, 59 / 60) and q.open_beam_ok is False and quality["b"].lines_out == 7


def test_open_beam_counts_levels(spark):
    rng = np.random.default_rng(11)
    size = (3, 40, 5)  # rows, lines, bands
    raw = {k: np.floor(rng.normal(1500, 300, size)) for k in "ab"}
    raw["a"][:, :4, 1] = 4095  # clips too often
    dark, white, ok = rng.normal(100, 5, (3, 5)), rng.normal(2000, 50, (3, 5)), np.ones((3, 5), bool)
    white[0, 0], ok[0, 0], ok[:, 3] = 0, False, False
    rows = [(k, "s", 0.9, a[r, n].tolist(), dark[r].tolist(), white[r].tolist(), ok[r].tolist()) for k, a in raw.items() for r in range(3) for n in range(40)]
    rows.append(("a", "s", 0.9, None, dark[0].tolist(), white[0].tolist(), ok[0].tolist()))
    lit = spark.createDataFrame(rows, "capture string, set string, k double, c array<double>, dark array<double>, white array<double>, ok array<boolean>")
    valid = spark.createDataFrame([("s", b, int(ok[:, b].sum())) for b in range(5)], "set string, band int, valid_rows long")
    out = P.open_beam_by_capture(lit, valid, 4095, 2)
    want = {}
    for k, a in raw.items():
        per = []
        for b in (0, 2, 4, *([1] if k == "b" else [])):
            c, u = a[ok[:, b], :, b], ((a[:, :, b] - dark[:, None, b]) / np.where(ok[:, b], white[:, b], 1)[:, None] * 0.9)[ok[:, b]]
            per.append(np.median(u[c >= np.quantile(c, 0.9)]))
        want[k] = len(per), np.median(per)
    got = {r.capture: r for r in out.collect()}
    assert {k: r.open_beam_bands for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(math.isclose(got[k].open_beam, m) for k, (_, m) in want.items())
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate ") == 2 and not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[capture", plan)  # cells are opened twice, and never joined by shuffle
    assert P.open_beam_by_capture(lit, valid, 4095, 4).count() == 0


def test_no_capture_is_one_task(spark, scene, monkeypatch):
    cal, raw = scene
    catalog = spark.createDataFrame([("dark_sample", None, "dark_sample/50k"), ("dark_white", None, "dark_white/2k"), ("white", None, "white/2k"), ("dark", None, "d")], CATALOG)
    captures = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.7)], "capture string, day int, factor double")
    lines = spark.createDataFrame([row for k, a in cal.items() for row in lines_of(k, a)], "folder string, row int, line int, c array<double>")
    cube = spark.createDataFrame([row for k in "ab" for row in lines_of(k, raw)], "capture string, row int, line int, c array<double>")
    plans, write = {}, P.written
    monkeypatch.setattr(P, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().sparkPlan().toString()}) or write(df, tag))
    bundle = C.transmittance_bundle(catalog, captures)
    P.correct_transmittance(cube, captures, bundle, C.reference_cells(lines, bundle, "row", "c"), 8)
    dark = spark.createDataFrame([("d", r, [0.0] * 8) for r in range(6)], "folder string, row int, dark array<double>")
    tape = cube.select("capture", "row", "line")
    P.correct_reflectance(cube, captures, C.reflectance_bundle(catalog, captures), dark, tape, 8)
    for tag in ("transmittance", "reflectance"):
        assert "Join [capture" in plans[tag] and not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[(capture#\d+\]|set#)", plans[tag])


def test_written_cubes_replace_only_their_captures(spark, scene, tmp_path):
    rows = [("a", 0, 0, [1.0, math.nan]), ("b", 0, 0, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "capture string, row int, line int, t array<double>")
    path = f"file://{tmp_path}/cube"
    _, told = P.write_cube(P.Corrected(df, df), path)
    assert told == {"pixels": 2, "invalid_cells": 1}
    again = df.where("capture = 'b'").withColumn("line", F.lit(7))
    cube, told = P.write_cube(P.Corrected(again, again), path)
    assert told == {"pixels": 1, "invalid_cells": 0}
    assert {(r.capture, r.line) for r in cube.collect()} == {("a", 0), ("b", 7)}


def test_reflectance_plan(spark):
    rng = np.random.default_rng(3)
    raw = np.round(rng.normal(1500, 300, (6, 12, 4)))
    raw[0, 0, 0] = 3
    dark = rng.normal(100, 3, (6, 4))
    tape = {"a": [(r, n) for r in (0, 1, 3, 5) for n in range(3, 9) if not (r == 5 and n > 4)], "b": [], "c": [(2, 4)]}
    captures = spark.createDataFrame([(k, 1, 1.0) for k in "abc"], "capture string, day int, factor double")
    bundle = C.reflectance_bundle(spark.createDataFrame([("dark", None, "d")], CATALOG), captures)
    frames = spark.createDataFrame([("d", r, dark[r].tolist()) for r in range(6)], "folder string, row int, dark array<double>")
    cube = spark.createDataFrame([row for k in "abc" for row in lines_of(k, raw)], "capture string, row int, line int, c array<double>")
    spots = spark.createDataFrame([(k, r, n) for k, at in tape.items() for r, n in at], "capture string, row int, line int")
    sub = np.floor(np.maximum(raw - dark[:, None], 0))
    for coverage, trusted in ((0.75, (0, 1, 3)), (2.0, (0, 1, 3, 5))):  # nothing reaches twice the median: every covered row counts
        done = P.correct_reflectance(cube, captures, bundle, frames, spots, 4, coverage=coverage)
        got = {(r.capture, r.row, r.line): r.r for r in done.cube.collect()}
        known = {r: np.percentile(sub[r, [n for q, n in tape["a"] if q == r]], 75, axis=0) for r in trusted}
        white = np.array([np.interp(range(6), sorted(known), [known[r][b] for r in sorted(known)]) for b in range(4)]).T
        assert np.allclose([[got["a", r, n] for n in range(6)] for r in range(6)], (sub / white[:, None])[:, 3:9])
        assert np.allclose([[got["b", r, n] for n in range(12)] for r in range(6)], sub)
        assert len([k for k in got if k[0] == "c"]) == 6
        q = {r.capture: r for r in done.quality.collect()}
        assert (q["a"].trusted_rows, q["a"].interpolated_rows, q["a"].first_line, q["a"].last_line) == (len(trusted), 6 - len(trusted), 3, 8)
        assert (q["b"].tape_pixels, q["b"].trusted_rows, q["a"].n_below_dark) == (None, 0, int((raw < dark[:, None]).sum()))


def test_weights_by_key_are_those_of_one_axis(spark):
    sizes = [("a", 12, 0.6), ("b", 7, 1.7), ("c", 5, 1.0), ("d", 3, 0.1), ("e", 1, 4.0)]
    got = {}
    for r in R.axis_weights_by(spark.createDataFrame(sizes, "k string, n int, factor double"), "k").collect():
        got[r.k, r.src, r.out] = r.w
    for k, n, f in sizes:
        want = {(k, r.src, r.out): r.w for r in R.axis_weights(spark, n, f).collect()}
        mine = {key: w for key, w in got.items() if key[0] == k}
        assert mine.keys() == want.keys() and all(math.isclose(mine[key], want[key], abs_tol=1e-9) for key in want)


def test_near_points_and_boards_seen_again(spark):
    rng = np.random.default_rng(9)
    # on and around cell borders, with reaches of several powers of two, and odd rows
    rows = [(int(c), i, float(rng.integers(-8, 9)) * 2 + float(rng.choice([0, 0, 0.5])), float(rng.integers(-8, 9)) * 2, float(rng.choice([0.5, 1, 2, 3, 4, 7]))) for i, c in enumerate(rng.integers(0, 3, 160))]
    rows += [(0, 500, None, 1.0, 2.0), (0, 501, 1.0, 1.0, 0.0), (0, 502, 1.0, 1.0, None), (7, 503, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "capture int, board int, x double, y double, reach double")
    placed = [r for r in rows if r[2] is not None]
    near = lambda a, b: b[4] and math.hypot(a[2] - b[2], a[3] - b[3]) < b[4]
    want = {(a[0], a[1], b[1]) for a in placed for b in placed if a[0] == b[0] and a[1] != b[1] and near(a, b)}
    got = nearby.near_pairs(df, ["capture"], "board", "x", "y", "reach").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    kept, same = {}, {}
    for b in sorted(rows, key=lambda r: r[1]):
        hits = [a[1] for a in kept.get(b[0], []) if (b[0], a[1], b[1]) in want]
        same[b[0], b[1]] = min(hits) if hits else None
        if not hits:
            kept.setdefault(b[0], []).append(b)
    found = nearby.first_of_near(df, ["capture"], "board", "x", "y", "reach").collect()
    assert len(found) == len(rows) and {(r.capture, r.board): r.same_as for r in found} == same
