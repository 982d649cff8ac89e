import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specloom.operators import radiometry as R


@pytest.fixture(scope="module")
def cube(spark):
    """6 rows x 5 lines x 7 bands of counts with one blank line."""
    rng = np.random.default_rng(2)
    a = rng.integers(200, 4000, (6, 5, 7))
    a[:, 3, :] = 0
    rows = [(r, line, a[r, line].astype(float).tolist()) for r in range(6) for line in range(5)]
    return a, spark.createDataFrame(rows, "row int, line int, c array<double>")


def test_reference_frame_skips_blank_lines(cube):
    a, df = cube
    kept = np.delete(a, 3, axis=1)
    for how, want in (("median", np.median(kept, axis=1)), ("mean", kept.mean(axis=1))):
        got = R.reference_frame(df, ["row"], "c", 7, how).orderBy("row").toPandas()
        assert np.allclose(np.stack(got["frame"]), want)


def test_transmittance_keeps_negatives_and_masks_invalid(spark):
    cube = spark.createDataFrame([(0, 0, [50.0, 300.0, 10.0])], "row int, line int, c array<double>")
    frames = spark.createDataFrame(
        [(0, [100.0, 100.0, 0.0], [200.0, 400.0, 1.0], [True, True, False])],
        "row int, dark array<double>, white array<double>, valid array<boolean>",
    )
    t = R.transmittance(cube, frames, "row", "c", 2.0).first()["t"]
    assert t[:2] == [-0.5, 1.0] and math.isnan(t[2])


def test_dark_subtract_truncates(spark):
    cube = spark.createDataFrame([(0, [10.0, 5.0])], "row int, c array<double>")
    dark = spark.createDataFrame([(0, [2.5, 9.0])], "row int, dark array<double>")
    got = R.dark_subtract(cube, dark, "row", "c").first()["c"]
    assert got == [7, 0]
    white = spark.createDataFrame([(0, [14.0, 0.0])], "row int, white array<double>")
    r = R.white_correct(R.dark_subtract(cube, dark, "row", "c"), white, "row", "c").first()["r"]
    assert r == [0.5, None]


def test_neighbour_fill_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, lines, bands = 9, 3, 8
    a = rng.normal(size=(rows, lines, bands))
    valid = rng.random((rows, bands)) > 0.25
    valid[:3, 5:] = False
    cube = spark.createDataFrame(
        [(r, k, np.where(valid[r], a[r, k], np.nan).tolist()) for r in range(rows) for k in range(lines)],
        "row int, line int, t array<double>",
    )
    v = spark.createDataFrame([(r, b, bool(valid[r, b]), b != 6) for r in range(rows) for b in range(bands)], "row int, band int, valid boolean, band_kept boolean")
    got = R.fill_bad_cells(cube, R.fill_sources(v, "row"), "row", "line", "t").toPandas().set_index(["row", "line"])["t"]
    for r in range(rows):
        for b in range(bands):
            near = [(i, j) for i in range(max(r - 1, 0), min(r + 2, rows)) for j in range(max(b - 1, 0), min(b + 2, bands))
                    if (i, j) != (r, b) and valid[i, j]]
            for k in range(lines):
                x = got[(r, k)][b]
                if valid[r, b]:
                    assert x == a[r, k, b]
                elif b != 6 and len(near) >= 4:
                    assert abs(x - np.mean([a[i, k, j] for i, j in near])) < 1e-12
                else:
                    assert math.isnan(x)


def test_white_validity_rules(spark):
    dark = spark.createDataFrame([(r, [10.0, 10.0, 10.0]) for r in range(4)] + [(4, [10.0, 90.0, 10.0])], "row int, dark array<double>")
    white = spark.createDataFrame([(r, [1000.0, 1000.0, 300.0]) for r in range(3)] + [(3, [50.0, 1000.0, 300.0]), (4, [1000.0, 1000.0, 300.0])], "row int, white array<double>")
    v = {(r["row"], r["band"]): r for r in R.white_validity(dark, white, "row").collect()}
    assert not v[(3, 0)]["cell_valid"] and not v[(4, 1)]["cell_valid"] and v[(0, 0)]["valid"]
    assert v[(0, 2)]["cell_valid"] and not v[(0, 2)]["band_kept"] and not v[(0, 2)]["valid"]


def overlap_mean(x, factor):
    n, m = len(x), max(1, round(len(x) * factor))
    out = []
    for j in range(m):
        lo, hi = j * n / m, (j + 1) * n / m
        w = np.array([max(0, min(hi, i + 1) - max(lo, i)) for i in range(n)])
        out.append((w * x).sum() / w.sum())
    return out


@pytest.mark.parametrize("factor", [0.3, 0.6, 1.0, 1.7])
def test_resample_axis(spark, factor):
    x = np.random.default_rng(0).normal(size=10)
    df = spark.createDataFrame([("a", i, [float(v)]) for i, v in enumerate(x)], "k string, line bigint, v array<double>")
    got = R.resample_axis(df, "line", ["k"], "v", 1, R.axis_weights(spark, 10, factor)).orderBy("line").toPandas()
    y = [v[0] for v in got["v"]]
    if factor <= 1:
        assert np.allclose(y, overlap_mean(x, factor))
    else:
        at = np.clip((np.arange(17) + 0.5) * 10 / 17 - 0.5, 0, 9)
        assert np.allclose(y, np.interp(at, np.arange(10), x))


def test_resample_mask_any_source(spark):
    df = spark.createDataFrame([("a", i, [i == 3]) for i in range(10)], "k string, line bigint, v array<boolean>")
    got = R.resample_mask(df, "line", ["k"], "v", 1, R.axis_weights(spark, 10, 0.5)).orderBy("line").collect()
    assert [r["v"][0] for r in got] == [False, True, False, False, False]


def test_line_period(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 10, 20, 20, 35)] + [("b", 1), ("b", 2)], "k string, t bigint")
    got = {r["k"]: r["period"] for r in R.line_period(df, ["k"], "t").collect()}
    assert got == {"a": float(np.median([10, 10, 0, 15])), "b": None}


def test_band_mean_and_stretch(spark):
    df = spark.createDataFrame([([1.0, math.nan, 3.0], [True, True, False], [False, True, True])], "v array<double>, kept array<boolean>, clip array<boolean>")
    r = R.band_mean(df, "v", "kept", "clip").first()
    assert r["band_mean"] == 1.0 and r["clip_frac"] == 0.5
    px = spark.createDataFrame(pd.DataFrame({"x": np.arange(101.0)}))
    g = R.percentile_stretch(px, "x").agg(F.min("gray"), F.max("gray")).first()
    assert tuple(g) == (0, 255)


def test_tape_rules(spark):
    rows = [(r, k, [float(10 * r + k)]) for r in range(4) for k in range(8)]
    cube = spark.createDataFrame(rows, "row int, line int, c array<double>")
    tape = spark.createDataFrame([(r, k) for r in (0, 1, 3) for k in range(8 if r != 3 else 2)], "row int, line int")
    got = {r["row"]: r["white"] for r in R.tape_white(cube, "row", "line", "c", tape).collect()}
    assert got == {0: 5.25, 1: 15.25}
    assert tuple(R.tape_span(tape, "line").first()) == (0, 7)


def test_open_beam_reads_one(spark):
    raw = spark.createDataFrame([(r, k, [1000.0 if k < 3 else 2100.0, 4095.0]) for r in range(40) for k in range(10)], "row int, line int, c array<double>")
    frames = spark.createDataFrame([(r, [100.0, 100.0], [2000.0, 2000.0], [True, True]) for r in range(40)], "row int, dark array<double>, white array<double>, cell_valid array<boolean>")
    per = R.open_beam_check(raw, "row", "c", frames)
    got = {r["band"]: r["median_t"] for r in per.collect()}
    assert got == {0: 1.0, 1: None}
    assert R.open_beam_verdict(per).first()["ok"]
