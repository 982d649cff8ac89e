import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specloom.operators import consistency as C
from specloom.operators import lattice as L
from specloom.operators import plate as P


@pytest.fixture(scope="module")
def plates(spark):
    """Three plates: straight, rotated by 180 degrees, and one with too few wells."""
    rng = np.random.default_rng(7)
    wells = [(s // 7, s % 7) for s in L.KERNEL_SPOTS]
    rows = []
    for cap, turn, keep in (("straight", 1, 22), ("turned", -1, 20), ("sparse", 1, 5)):
        for n, (r, c) in enumerate(wells[:keep]):
            x, y = turn * c * 74.0 + 800, turn * r * 134.0 + 900
            rows.append((cap, n, x + rng.normal(0, 1), y + rng.normal(0, 1)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["cap", "seed", "x", "y"]))


def test_fit_finds_pose_and_status(spark, plates):
    # Marker 0 sits at plate cell (3, 3), marker 1 at (2, 6); one of them is read 55 pixels off.
    marks = [(cap, m, t * c * 74.0 + 800 + off, t * r * 134.0 + 900) for cap, t, off in (("straight", 1, 0.0), ("turned", -1, 30.0), ("off", 1, 0.0))
             for m, (r, c) in enumerate(((3, 3), (2, 6)))]
    marks = [(cap, m, x, y + 55.0 * (cap == "off" and m == 1)) for cap, m, x, y in marks]
    again = plates.where("cap = 'straight'").withColumn("cap", F.lit("off"))
    known = spark.createDataFrame([("straight", None), ("turned", None), ("sparse", None), ("off", None), ("broken", "unreadable")], "cap string, error string")
    fits = L.fit_plates(plates.unionByName(again), spark.createDataFrame(marks, "cap string, marker_id int, x double, y double"), ["cap"], known)
    got = {r["cap"]: r for r in fits.collect()}
    assert got["off"]["status"] == "needs_review" and got["off"]["flags"] == ["marker_offset"] and got["off"]["markers_off"] == 1
    assert abs(got["off"]["marker_offsets_px"][1] - 55) < 3 and got["broken"]["status"] == "error" and got["broken"]["reasons"] == ["unreadable"]
    assert got["straight"]["chirality"] == "right" and abs(got["turned"]["angle_deg"] - 180) < 1 and len(got["turned"]["empty"]) == 2
    assert got["straight"]["pose"] == "identity" and got["straight"]["status"] == "pass"
    assert got["turned"]["pose"] == "rot180" and got["turned"]["n_matched"] == 20
    assert abs(got["turned"]["pitch_x"] - 74) < 1 and abs(got["turned"]["pitch_y"] - 134) < 1
    assert got["sparse"]["status"] == "fail" and got["sparse"]["reasons"] == ["too_few_wells"]


def test_lattice_indices_of_rotated_plates_with_gaps():
    rng = np.random.default_rng(3)
    for angle in (0.0, 0.4, 2.0):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        at = np.array([(s % 7, s // 7) for s in L.KERNEL_SPOTS if rng.random() > 0.25])
        pts = (at * [74.0, 134.0]) @ turn.T + 500 + rng.normal(0, 2, (len(at), 2))
        index, frame = L.walk_indices(pts, *L.periods(pts))
        assert np.abs(pts - frame[0] - index @ frame[1:]).max() < 10
        assert len(np.unique(index, axis=0)) == len(at)


def test_constant_profiles_do_not_track(spark):
    rows = [(1, k, w, 0.5 if k == 0 else float(w % 5) + 0.01 * k) for k in range(4) for w in range(22)]
    df = spark.createDataFrame(rows, "dish int, k int, well int, occ double")
    got = {r["k"]: r["verdict"] for r in C.pose_agreement(df, "dish", "k", "well", "occ").collect()}
    assert got[1] == "ok" and got.get(0, "not_tracking") == "not_tracking"
    flat = spark.createDataFrame([("a", float(i), 1.0) for i in range(6)] + [("b", float(i), 2.0 * i) for i in range(6)], "g string, x double, y double")
    got = {r["g"]: r["corr"] for r in C.null_safe_corr(flat, ["g"], "x", "y").collect()}
    assert got["a"] is None and abs(got["b"] - 1) < 1e-9


def test_side_from_marker_ids(spark):
    seen = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 1)], "cap string, marker_id int")
    got = {r["cap"]: r["side_observed"] for r in P.side_from_ids(seen, ["cap"]).collect()}
    assert got == {"a": "dorsal", "b": None}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7])
def test_leave_one_out_median(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "g string, i int, x double")
    got = {r["i"]: r["ref"] for r in C.leave_one_out_median(df, ["g"], "i", "x").collect()}
    for i in range(n):
        rest = np.delete(v, i)
        assert got[i] == (None if n == 1 else pytest.approx(np.median(rest)))


def test_planted_mislabel_is_caught(spark):
    rng = np.random.default_rng(1)
    truth = rng.uniform(0.1, 0.9, 22)
    wrong = {r["index"]: r["other"] for r in P.wrong_poses(spark).where("pose = 'rot180'").collect()}
    rows = []
    for k in range(6):
        for w in range(22):
            src = wrong[w] if k == 5 else w
            if src is not None:
                rows.append((1, k, w, float(truth[src] + rng.normal(0, 0.02))))
    got = {r["k"]: r for r in C.pose_agreement(spark.createDataFrame(rows, "dish int, k int, well int, occ double"), "dish", "k", "well", "occ").collect()}
    assert all(got[k]["verdict"] == "ok" for k in range(5))
    assert got[5]["verdict"] in ("not_tracking", "wrong_pose_fits_better") and got[5]["best_wrong_pose"] == "rot180"


def test_capture_exceptions(spark):
    rows = [(1, "a", "dorsal", "pass", "dorsal", "L", 74.0, 134.0), (1, "b", "dorsal", "pass", "ventral", "R", 79.0, 134.0),
            (1, "c", "ventral", "fail", None, None, 10.0, 10.0), (2, "d", "dorsal", "pass", None, "L", 74.0, 134.0)]
    df = spark.createDataFrame(rows, "dish int, capture string, side string, status string, side_observed string, chirality string, pitch_x double, pitch_y double")
    assert {(r["dish"], r["kind"]) for r in C.capture_exceptions(df).collect()} == {
        (1, "failed"), (1, "side_mismatch"), (1, "handedness"), (1, "pitch_x_spread")}


def test_reads_merge_and_boards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, v string")
    assert {r["k"]: r["v"] for r in C.merge_reads(a, b, key=["k"], value="v").collect()} == {1: "z", 2: "y"}
    boards = spark.createDataFrame([("c", 10.0, 0.5, 2.0), ("c", 11.0, 9.0, 2.0), ("c", 12.0, 0.5, 30.0)], "k string, s double, rms double, skew double")
    r = C.reconcile_scales(boards, ["k"], "s").first()
    assert r["scale"] == 11.0 and abs(r["rel_spread"] - 2 / 11) < 1e-12
    got = [x["j"]["reason"] for x in boards.select(C.judge_board("rms", "skew", "s").alias("j")).collect()]
    assert got == [None, "rms", "skew"]


def test_wells_are_filtered_and_thinned(spark):
    rows = [("c", 0, 0.0, 0.0), ("c", 1, 20.0, 0.0), ("c", 2, 40.0, 0.0), ("d", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cap string, o int, x double, y double")
    got = {(r["cap"], r["o"]) for r in L.thin_by_radius(df, ["cap"], "o").collect()}
    assert got == {("c", 0), ("c", 2), ("d", 0)}
    blobs = spark.createDataFrame([(50.0, 100.0, 4000.0, 0.9), (50.0, 100.0, 4000.0, 0.3), (10.0, 100.0, 4000.0, 0.9)], "s double, l double, a double, f double")
    assert [r[0] for r in blobs.select(L.well_like("s", "l", "a", "f")).collect()] == [True, False, False]


def test_poses_of_many_captures_are_scored_in_one_task_at_once(spark):
    rng = np.random.default_rng(8)
    seeds = [(k, int(i), int(j)) for k in range(2100) for i, j in zip(rng.integers(-1, 8, 9), rng.integers(-1, 5, 9))] + [(-1, None, 2), (-1, 1, 1)]
    marks = [(k, int(rng.integers(0, 4)), 3, 2) for k in range(0, 2100, 3)] + [(-1, 9, 1, 1), (-1, 0, None, None)]
    got = L.choose_pose(spark.createDataFrame(seeds, "k int, i int, j int").repartition(1), spark.createDataFrame(marks, "k int, marker_id int, i int, j int"), ["k"])
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["k"]: r for r in got.collect()}
    assert len(rows) == 2101
    for k in (-1, 0, 1, 777, 2099):
        score = []
        for pose, flip_row, flip_col in L.POSES:
            for dr in range(-2, 3):
                for dc in range(-2, 3):
                    spot = lambda i, j: None if i is None or j is None else ((3 - j if flip_row else j) + dr, (6 - i if flip_col else i) + dc)  # noqa: E731, B023
                    places = [(i, j) for g, i, j in seeds if g == k]
                    kernel = {(n // 7, n % 7) for n in L.KERNEL_SPOTS}
                    s = -2.0 * len(kernel) + sum(3.0 if spot(*p) in kernel else -2.0 for p in set(places)) - 2.0 * (len(places) - len(set(places)))
                    s += sum(8.0 if m in L.MARKER_CELL and spot(i, j) == L.MARKER_CELL[m] else -8.0 for g, m, i, j in marks if g == k)
                    score.append(s)
        top = sorted(score, reverse=True)
        assert (rows[k]["cand"], rows[k]["score"], rows[k]["margin"]) == (score.index(top[0]), top[0], top[0] - top[1])
