import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.operators import masks as K
from specloom.operators import patches
from specloom.operators import plate as P


def to_rle(mask):
    flat, runs, val, n = mask.T.ravel(), [], 0, 0
    for x in flat:
        if x != val:
            runs.append(n)
            val, n = x, 0
        n += 1
    return [*runs, n]


def from_segments(rows, h, w):
    m = np.zeros((h, w), bool)
    for r in rows:
        m[r["r0"] : r["r1"] + 1, r["c"]] = True
    return m


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    h, w = 17, 23
    ms = [rng.random((h, w)) < p for p in (0.3, 0.5, 0.7, 0.9)]
    df = spark.createDataFrame([(i, h, w, [int(x) for x in to_rle(m)]) for i, m in enumerate(ms)], "id int, h bigint, w bigint, counts array<int>")
    return ms, df, h, w


def test_rle_literal(spark):
    df = spark.createDataFrame([(1, 3, [3, 2, 4, 1, 2])], "id int, h int, counts array<int>")
    seg = K.decode_rle(df, ["id"], "counts").orderBy("c").collect()
    assert [(r["r0"], r["c"]) for r in seg] == [(0, 1), (0, 3)] and seg[0]["r1"] == 1
    assert K.mask_box(K.decode_rle(df, ["id"], "counts"), ["id"]).first()["area"] == 3


def test_rle_round_trip(blobs):
    ms, df, h, w = blobs
    seg = K.decode_rle(df, ["id"], "counts").collect()
    for i, m in enumerate(ms):
        assert (from_segments([r for r in seg if r["id"] == i], h, w) == m).all()


def flood(m):
    label, n = np.zeros(m.shape, int), 0
    for s in zip(*np.nonzero(m)):
        if label[s]:
            continue
        n += 1
        stack = [s]
        label[s] = n
        while stack:
            r, c = stack.pop()
            for i in range(max(r - 1, 0), min(r + 2, m.shape[0])):
                for j in range(max(c - 1, 0), min(c + 2, m.shape[1])):
                    if m[i, j] and not label[i, j]:
                        label[i, j] = n
                        stack.append((i, j))
    return label, n


def test_largest_component(blobs):
    ms, df, h, w = blobs
    kept, stats = K.largest_component(K.decode_rle(df, ["id"], "counts"), ["id"])
    kept, stats = kept.collect(), {r["id"]: r for r in stats.collect()}
    for i, m in enumerate(ms):
        label, n = flood(m)
        sizes = np.bincount(label.ravel())[1:]
        assert stats[i]["n_components"] == n and stats[i]["dropped_px"] == m.sum() - sizes.max()
        assert (from_segments([r for r in kept if r["id"] == i], h, w) == (label == sizes.argmax() + 1)).all()
        assert (patches._keep_largest(m) == (label == sizes.argmax() + 1)).all()


@pytest.mark.parametrize("px", [0, 1, 2])
def test_erode(blobs, px):
    ms, df, h, w = blobs
    got = K.erode(K.decode_rle(df, ["id"], "counts"), ["id"], px, df).collect()
    window = {0: [(0, 0)], 1: [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)],
              2: [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if abs(dr) < 2 or dc == 0]}[px]
    for i, m in enumerate(ms):
        want = m.copy()
        for dr, dc in window:
            pad = np.pad(m, 2, constant_values=True)
            want &= pad[2 + dr : 2 + dr + h, 2 + dc : 2 + dc + w]
        assert (from_segments([r for r in got if r["id"] == i], h, w) == want).all()


def test_prepare_erodes_between_two_component_passes(spark, blobs):
    ms, df, h, w = blobs
    m = np.zeros((h, w), bool)
    m[2:7, 2:7] = m[2:7, 9:17] = m[4, 7:9] = m[12, 20] = True  # two blocks on a bridge, and a speck
    one = spark.createDataFrame([(1, h, w, [int(x) for x in to_rle(m)])], "id int, h bigint, w bigint, counts array<int>")
    kept, stats = K.prepare(K.decode_rle(one, ["id"], "counts"), ["id"], 1, one)
    want = np.zeros((h, w), bool)
    want[3:6, 10:16] = want[4, 9] = True
    assert (from_segments(kept.collect(), h, w) == want).all()
    assert tuple(stats.first()) == (1, 2, 1, int(m.sum()) - 1)


def test_quads_and_later_cell_wins(spark):
    rows = [(1, "a", 0, [[1.0, 1.0], [5.0, 1.0], [5.0, 4.0], [1.0, 4.0]]), (1, "b", 1, [[4.0, 2.0], [8.0, 2.0], [8.0, 6.0], [4.0, 6.0]]),
            (1, "c", 2, [[12.0, 0.0], [14.0, 2.0], [12.0, 4.0], [10.0, 2.0]])]
    df = spark.createDataFrame([(*r, 8, 20) for r in rows], "k int, label string, ord int, corners array<array<double>>, h int, w int")
    seg = K.cell_labels(K.quad_segments(df, ["k"], "h", "w"), ["k"], "label", "ord").collect()
    grid = np.full((8, 20), ".")
    for r in seg:
        grid[r["r0"] : r["r1"] + 1, r["c"]] = r["label"]
    assert (grid[1:5, 1:4] == "a").all() and (grid[2:7, 4:9] == "b").all() and (grid[1, 4:6] == "a").all()
    assert [(grid[:, c] == "c").sum() for c in range(10, 15)] == [1, 3, 5, 3, 1]


def test_assignment_reports_every_problem(spark):
    caps = spark.createDataFrame([("ok", 10, 40, "pass", [1, 2, 3]), ("shape", 9, 40, "pass", [1]), ("bad", 10, 40, "fail", [1])],
                                 "cap string, h int, w int, status string, wells array<int>")
    labels = spark.createDataFrame([("ok", c, 0, 9, lab) for c in range(40) for lab in [1 + c // 10 if c < 30 else 200]], "cap string, c bigint, r0 bigint, r1 bigint, label int")
    seg = []
    def box(cap, m, c0, c1, r0=0, r1=4):
        seg.extend((cap, m, c, r0, r1) for c in range(c0, c1))
    box("ok", 1, 1, 5)
    box("ok", 2, 2, 4)
    box("ok", 3, 12, 20)
    box("ok", 4, 33, 36)
    box("ok", 6, 25, 38)
    box("shape", 7, 0, 3)
    box("bad", 8, 0, 3)
    masks = spark.createDataFrame([(c, m, m, 10, 40, 7 if m == 9 else 0) for c, m in [("ok", 1), ("ok", 2), ("ok", 3), ("ok", 4), ("ok", 5), ("ok", 6), ("ok", 9), ("shape", 7), ("bad", 8)]],
                                  "cap string, m int, pos int, h int, w int, raw_px int")
    segs = spark.createDataFrame(seg, "cap string, m int, c bigint, r0 bigint, r1 bigint")
    rows, problems = K.assign(masks, segs, labels, caps, ["cap"], "m", "pos")
    assert {(r["m"], r["cell_index"], r["containment"]) for r in rows.collect()} == {(1, 0, 1.0), (3, 1, 1.0)}
    assert {(r["cap"], r["m"], r["problem"]) for r in problems.collect()} == {
        ("ok", 2, "TWO_MASKS_ONE_CELL"), ("ok", 4, "MASK_OFF_LATTICE"), ("ok", 5, "EMPTY_MASK"), ("ok", 9, "MASK_ERODED_AWAY"), ("ok", 6, "MASK_STRADDLES_CELLS"),
        ("ok", None, "CELL_WITHOUT_MASK"), ("shape", None, "SHAPE_MISMATCH"), ("bad", None, "FIT_FAILED")}


def test_patch_of_an_axis_aligned_cell(spark):
    width, lines, bands = 60, 90, 3
    rng = np.random.default_rng(0)
    a = rng.uniform(0.1, 0.9, (width, lines, bands)).astype(np.float32)
    cube = spark.createDataFrame(
        [("cap", r, y, a[r, y].tolist(), [False] * bands, 20 <= y < 60) for r in range(width) for y in range(lines)],
        "cap string, row int, line int, bands array<float>, sat array<boolean>, inside boolean")
    stored = patches.working_pixels(cube, width).select("cap", "x", "y", "bands")
    assert patches.frame_identity(cube, stored, ["cap"], width).count() == 0
    moved = stored.withColumn("y", F.when(F.col("x") == 3, F.lit(lines - 1) - F.col("y")).otherwise(F.col("y")))
    assert patches.frame_identity(cube, moved, ["cap"], width).count() == lines
    views = spark.createDataFrame([("cap", "v", [[10.0, 15.0], [42.0, 15.0], [42.0, 79.0], [10.0, 79.0]], width, lines)],
                                  "cap string, view string, corners array<array<double>>, w int, n int")
    px = patches.view_pixels(views, patches.working_pixels(cube, width), ["cap"], "view", "w", "n")
    got = patches.cut_patches(px, ["cap"], "view", 64, 32).toPandas()
    assert len(got) == 64 * 32 and got["nan_frac"].iloc[0] == 0 and got["sat_frac"].iloc[0] == 0
    p = np.stack(got["bands"]).reshape(64, 32, bands)
    want = -np.log10(a[::-1].transpose(1, 0, 2)[15:79, 10:42])
    assert np.abs(p - want).max() < 2e-3
    inside = got["inside"].to_numpy().reshape(64, 32)
    assert (inside == ((np.arange(64)[:, None] + 15 >= 20) & (np.arange(64)[:, None] + 15 < 60))).all()
    mean = patches.mask_mean_spectrum(spark.createDataFrame(got), ["view"], "bands", bands).first()["spectrum"]
    assert np.allclose(mean, p[inside].mean(0), atol=1e-5)


def test_plate_model(spark):
    cells = P.cells(spark).toPandas()
    assert cells["kind"].value_counts().to_dict() == {"kernel": 22, "rim": 4, "marker": 2}
    assert cells[cells["name"] == "R0C1"]["index"].iloc[0] == 0 and cells["index"].max() == 21
    w = P.wrong_poses(spark).toPandas()
    assert len(w) == 66 and w[w["pose"] == "flip_col"]["other"].isna().sum() == 1


def test_many_masks_are_cleaned_at_once(spark):
    """Equal keys draw one mask, masks do not touch each other, and no task works mask by mask."""
    rng = np.random.default_rng(4)
    ms = [rng.random((9, int(w))) < 0.45 for w in rng.integers(1, 12, 2300)]
    rows = [(k, 9, m.shape[1], [int(x) for x in to_rle(m)]) for k, m in enumerate(ms)] + [(-1, 9, 4, [36]), (-2, 9, 4, None), (-3, 9, 4, [0, 2, 7]), (-3, 9, 4, [20, 3])]
    df = spark.createDataFrame(rows, "id int, h bigint, w bigint, counts array<int>").repartition(1)
    whole = K.gather_rle(df, ["id"], "counts")
    stats = K.largest_gathered(whole, ["id"])
    found = {r["id"]: r for r in stats.collect()}
    assert not {-1, -2} & set(found)
    assert (found[-3]["n_components"], found[-3]["raw_px"], found[-3]["dropped_px"]) == (2, 5, 2)
    for k, m in enumerate(ms):
        n, px = flood(m)[1], np.bincount(flood(m)[0].ravel())[1:]
        assert (k in found) == (n > 0)
        if n:
            assert (found[k]["n_components"], found[k]["dropped_px"]) == (n, px.sum() - px.max())
    kept, counted = K.prepare(K.decode_rle(df, ["id"], "counts"), ["id"], 1, df.where("id >= 0"))
    assert counted.count() == len(found)
    plans = [x._jdf.queryExecution().toString() for x in (stats, kept, K.erode(K.decode_rle(df, ["id"], "counts"), ["id"], 1, df))]
    assert not any("InPandas" in x for x in plans)
