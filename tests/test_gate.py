"""Every check once on data that passes and once on data that fails."""

import pytest

from specloom.operators import gate as G


@pytest.fixture(scope="module")
def t(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


CASES = {
    "row_ids": (lambda t, r: G.row_ids_dense(t([(i,) for i in r], "row int"), "row"), [0, 1, 2], [0, 2, 2]),
    "count": (lambda t, n: G.row_count_is(t([(1,), (2,)], "x int"), n), 2, 3),
    "views": (lambda t, r: G.views_per_unit(t([(k,) for k in r], "k string"), "k", 2, ["gap"]), ["a", "a", "gap"], ["a", "a", "b"]),
    "absent": (lambda t, r: G.absent(t([(k,) for k in r], "k string"), "k", ["empty"]), ["a"], ["a", "empty"]),
    "fd": (lambda t, r: G.one_value_per_key(t(r, "k int, v int"), "k", "v", "fd"), [(1, 2), (1, 2)], [(1, 2), (1, 3)]),
    "domain": (lambda t, r: G.within_domain(t([(x,) for x in r], "h double"), "h", [0.0, 8.0], "h"), [0.0, 8.0], [0.0, 9.0]),
    "finite": (lambda t, v: G.spectra_finite(t([(v,)], "v array<double>"), "v", 2), [1.0, 2.0], [1.0, float("nan")]),
    "recompute": (lambda t, v: G.recomputed_equal(t([(1, 2.0)], "k int, v double"), t([(1, v)], "k int, v double"), ["k"], "v", "r"), 2.0, 2.1),
    "labels": (lambda t, k: G.labels_join(t([(k,)], "k string"), t([("a",)], "k string"), "k"), "a", "z"),
    "classes": (lambda t, r: G.both_classes(t([(y,) for y in r], "y int"), "y"), [0, 1], [1, 1]),
    "several": (lambda t, r: G.several(t([(y,) for y in r], "d int"), "d", 2, "days"), [1, 2], [1, 1]),
    "leak": (lambda t, r: G.no_leakage(t(r, "k int, fold int"), "k", "leak"), [(1, 0), (2, 1)], [(1, 0), (1, 1)]),
    "fatal": (lambda t, p: G.no_fatal(t([(p,)], "problem string")), "NOTE", "MASK_OFF_LATTICE"),
    "lengths": (lambda t, n: G.same_count(t([(1,)] * 2, "x int"), t([(1,)] * n, "x int"), "lengths"), 2, 1),
    "rle": (lambda t, r1: G.rle_matches(t([(1, [3, 2, 1])], "k int, counts array<int>"), t([(1, 1, 0, r1)], "k int, c int, r0 int, r1 int"), ["k"], "counts"), 1, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_check(t, name):
    build, good, bad = CASES[name]
    assert build(t, good).first()["ok"]
    row = build(t, bad).first()
    assert not row["ok"] and row["violations"] > 0


def test_gate_stops_the_job(t):
    report = G.gate(G.both_classes(t([(1,), (0,)], "y int"), "y"), G.both_classes(t([(1,)], "y int"), "y", "second"))
    assert report.count() == 2
    with pytest.raises(Exception, match="gate failed: second"):
        G.require(report).collect()


def test_area_outliers(t):
    boxes = t([(i, 100 + i % 7) for i in range(400)] + [(999, 5), (1000, 900)], "k int, area int")
    assert {r["k"] for r in G.area_outliers(boxes, "area").collect()} == {999, 1000}
