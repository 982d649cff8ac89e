import json
import math
import zipfile

import numpy as np
import pytest

from specloom.operators import gate, masks
from specloom.sources import lines, readers, writers
from specloom.streaming.drop_folder import ingest


def pack(counts):
    c = counts.reshape(-1, 2).astype(int)
    return np.column_stack([c[:, 0] >> 4, ((c[:, 0] & 15) << 4) | (c[:, 1] & 15), c[:, 1] >> 4]).astype(np.uint8).tobytes()


def test_codec_literal():
    assert lines.unpack12(bytes([0xAB, 0xCD, 0xEF])).tolist() == [0xABC, 0xEFD]


@pytest.fixture()
def raw(tmp_path):
    """Two captures of a 4 x 6 sensor, with a short line and a line of zeros."""
    rng = np.random.default_rng(0)
    a = rng.integers(1, 4096, (2, 3, 6, 4))
    for k in range(2):
        folder = tmp_path / "raw" / f"cap{k}"
        folder.mkdir(parents=True)
        for n in range(3):
            (folder / f"{n:04d}_{n * 16:04x}_w4.bin").write_bytes(pack(a[k, n]))
        (folder / "0003_0040_w4.bin").write_bytes(b"\x01\x02\x03")
        (folder / "0004_0050_w4.bin").write_bytes(bytes(36))
    return tmp_path, a


def test_stitch_and_blank_lines(spark, raw):
    path, a = raw
    cube = lines.stitch(spark, str(path / "raw"), 4, 6)
    got = {(r["capture"][-4:], r["line"], r["row"]): r["bands"] for r in cube.collect()}
    assert len(got) == 2 * 5 * 4
    for k in range(2):
        for n in range(3):
            for row in range(4):
                assert got[(f"cap{k}", n, row)] == a[k, n, :, 3 - row].tolist()
    assert {(r["capture"][-4:], r["line"]) for r in lines.blank_lines(cube).collect()} == {(f"cap{k}", n) for k in (0, 1) for n in (3, 4)}


def test_stream_commits_every_line_once(spark, raw):
    path, _ = raw
    for _ in range(2):
        q = ingest(spark, str(path / "raw"), str(path / "out"), str(path / "ckpt"), 4, 6)
        q.awaitTermination(120)
    assert spark.read.option("basePath", str(path / "out")).parquet(str(path / "out")).count() == 2 * 5 * 4


def test_whole_capture_file(spark, tmp_path):
    (tmp_path / "capture.bin").write_bytes(bytes(range(36)) * 3)
    got = lines.whole_capture(spark, str(tmp_path / "capture.bin"), 36)
    assert got.count() == 3 and bytes(got.orderBy("line").collect()[2]["content"]) == bytes(range(36))
    (tmp_path / "ragged.bin").write_bytes(bytes(37))
    with pytest.raises(Exception, match="whole number of lines"):
        lines.whole_capture(spark, str(tmp_path / "ragged.bin"), 36).collect()


def test_discovery_and_calibration(spark, tmp_path):
    for d, n in ((10, 2), (2, 7), (2, 1)):
        f = tmp_path / "reflectance_images" / f"day{d}" / f"dish{n}" / "dorsal"
        f.mkdir(parents=True)
        (f / "capture.npy").write_bytes(b"x")
    got = [(r["day"], r["dish"]) for r in lines.discover(spark, str(tmp_path)).collect()]
    assert got == [(2, 1), (2, 7), (10, 2)]
    assert lines.discover(spark, str(tmp_path), days=None, day=[2]).count() == 2
    needs = spark.createDataFrame([(1, "dark"), (2, "dark"), (2, "white")], "day int, what string")
    found = spark.createDataFrame([(1, "dark", "own"), (None, "dark", "all")], "day int, what string, path string")
    res = {(r["day"], r["what"]): (r["path"], r["scope"]) for r in lines.resolve_calibration(needs, found).collect()}
    assert res == {(1, "dark"): ("own", "day"), (2, "dark"): ("all", "shared"), (2, "white"): (None, None)}
    twice = spark.createDataFrame([("a", "p"), ("a", "q")], "k string, path string")
    with pytest.raises(Exception, match="ambiguous"):
        lines.exactly_one(twice, ["k"]).collect()


def coco(extra=None, category="KERNEL"):
    name = "preview_coco/{}_images/day{}/dish{}/dorsal/p.png".format
    images = [{"id": 1, "file_name": name("reflectance", 1, 3), "height": 3, "width": 4},
              {"id": 2, "file_name": name("reflectance", 2, 3), "height": 3, "width": 4},
              {"id": 3, "file_name": name("reflectance", 9, 3), "height": 3, "width": 4}] + (extra or [])
    anns = [{"id": 5, "image_id": 1, "iscrowd": 1, "area": 3.0, "bbox": [1, 0, 3, 2], "segmentation": {"counts": [3, 2, 4, 1, 2], "size": [3, 4]}},
            {"id": 6, "image_id": 2, "iscrowd": 1, "area": 1.0, "bbox": [0, 0, 1, 1], "segmentation": {"counts": [0, 1, 11], "size": [3, 4]}}]
    return {"images": images, "annotations": anns, "categories": [{"id": 1, "name": category}]}


def test_annotations(spark, tmp_path):
    def load(doc, name):
        (tmp_path / name).write_text(json.dumps(doc))
        return readers.read_coco(spark, str(tmp_path / name), [1, 9])

    rows = load(coco(), "ok.json").collect()
    assert [(r["ann_id"], r["day"], r["dish"], r["h"]) for r in rows] == [(5, 1, 3, 3)]
    seg = masks.decode_rle(load(coco(), "ok.json"), ["ann_id"], "counts")
    assert masks.mask_box(seg, ["ann_id"]).first()["area"] == 3
    twin = [{"id": 4, "file_name": "preview_coco/reflectance_images/day1/dish3/dorsal/q.png", "height": 3, "width": 4}]
    with pytest.raises(Exception, match="annotated twice"):
        load(coco(twin), "twin.json").collect()
    with pytest.raises(Exception, match="unexpected categories"):
        load(coco(category="LEAF"), "cat.json").collect()


def label_csv(spark, tmp_path, text):
    (tmp_path / "l.csv").write_text(text)
    return readers.read_label_csv(spark, str(tmp_path / "l.csv"))


def test_label_csv(spark, tmp_path):
    got = label_csv(spark, tmp_path, "kernel_uid,first_germinated_day\na,2\nb,never\nc,\nd,TBD\ne,-1\n").collect()
    assert {r["kernel_uid"]: r["first_day"] for r in got} == {"a": 2, "b": None, "e": None}
    for bad, message in (("a,1\na,2\n", "labelled twice"), (" ,1\n", "empty kernel_uid"), ("a,7\n", "not an event day")):
        with pytest.raises(Exception, match=message):
            label_csv(spark, tmp_path, "kernel_uid,first_germinated_day\n" + bad).collect()
    with pytest.raises(ValueError):
        label_csv(spark, tmp_path, "kernel_uid,germinated\na,1\n")
    ok = label_csv(spark, tmp_path, "kernel_uid,first_germinated_day\na,1\n")
    units = spark.createDataFrame([("a",)], "kernel_uid string")
    assert readers.check_labels(ok, units, ["z"]).count() == 1
    with pytest.raises(Exception, match="without a unit"):
        readers.check_labels(ok, units, ["a"]).collect()


def sheet(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings, body = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            if v is None:
                continue
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                strings.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")


def test_label_grid(spark, tmp_path):
    def load(rows):
        sheet(tmp_path / "s.xlsx", rows)
        return readers.read_label_grid(readers.read_sheet(spark, str(tmp_path / "s.xlsx")), 3, 5)

    got = load([["dish", 0, 1, 2], [4, 1, "never", None], [0, None, 3, "?"]]).collect()
    assert {(r["dish"], r["cell_index"], r["first_day"]) for r in got} == {(4, 0, 1), (4, 1, None), (0, 1, 3)}
    # wells in another order, and a column of notes between them
    got = load([["dish", 2, "note", 0, 1], [4, 1, "wet", "never", None], [0, None, "dry", 3, 2]]).collect()
    assert {(r["dish"], r["cell_index"], r["first_day"]) for r in got} == {(4, 2, 1), (4, 0, None), (0, 0, 3), (0, 1, 2)}
    for rows, message in (([["dish", 1, 2, 3], [0, 1, 1, 1]], "header"), ([["dish", 0, 1, 1, 2], [0, 1, 1, 1, 1]], "header"), ([["dish", 0, 1, 2], [0, 1, 1, 1], [0, 2, 2, 2]], "repeated dish"),
                          ([["dish", 0, 1, 2], [7, 1, 1, 1]], "repeated dish"), ([["dish", 0, 1, 2], [0, "x", 1, 1]], "not an event day")):
        with pytest.raises(Exception, match=message):
            load(rows).collect()
    views = spark.createDataFrame([(4, 0, "dish4_R0C1"), (4, 1, "dish4_R0C2"), (0, 1, "dish0_R0C2")], "dish int, cell_index int, kernel_uid string")
    grid = load([["dish", 0, 1, 2], [4, 1, "never", None], [0, None, 3, None]])
    assert {r["kernel_uid"]: r["first_day"] for r in readers.grid_to_labels(grid, views).collect()} == {"dish4_R0C1": 1, "dish4_R0C2": None, "dish0_R0C2": 3}
    with pytest.raises(Exception, match="scored well without a unit"):
        readers.grid_to_labels(grid, views.where("dish = 4")).collect()


def test_timing_views_splits(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({
        "t0_by_dish": {"3": "2026-01-01T08:00:00"},
        "captures": {"reflectance|1|3|dorsal": {"time": "x", "hours": 0.5}},
        "visits_by_dish": {"3": [{"hours": 22.0}, {"hours": 48.0}]}}))
    clock, t0, visits = readers.read_timing(spark, str(tmp_path / "t.json"))
    assert visits.first()["visits"] == [22.0, 48.0] and t0.first()["t0"].hour == 8
    head = "row,kernel_uid,dish,cell,cell_index,variety,mode,side,day_folder,hours,coco_ann_id,coco_image_id,mask_px_raw,mask_px,patch_mask_px,containment,n_components_raw,dropped_px,clipped_frac,sat_frac,nan_frac,fit_status,source"
    line = "{},dish{}_R0C1,{},R0C1,0,{},reflectance,dorsal,1,0.0,1,1,10,9,8,1.0,1,0,0,0,0,pass,/x"
    (tmp_path / "v.csv").write_text("\n".join([head, line.format(0, 3, 3, 1), line.format(1, 7, 7, 2), line.format(2, 4, 4, 1)]))
    assert readers.read_views(spark, str(tmp_path / "v.csv"), include_excluded=True).count() == 3
    v = readers.with_clock(readers.read_views(spark, str(tmp_path / "v.csv")), clock)
    got = {r["dish"]: (r["capture_hours"], r["capture_time_source"]) for r in v.collect()}
    assert got[3] == (0.5, "measured") and math.isnan(got[4][0]) and got[4][1] == "none" and 7 not in got
    (tmp_path / "s.json").write_text(json.dumps({"folds": [{"train": ["b"], "test": ["a"]}, {"train": ["a"], "test": ["b"]}]}))
    assert {r["kernel_uid"]: r["fold"] for r in readers.read_splits(spark, str(tmp_path / "s.json")).collect()} == {"a": 0, "b": 1}


def test_cells_runs_and_fingerprints(spark, tmp_path):
    f = tmp_path / "grid" / "day1"
    f.mkdir(parents=True)
    (f / "cells.json").write_text(json.dumps({"capture": {"mode": "reflectance", "day": 1, "dish": 2, "side": "dorsal"}, "status": "pass",
                                              "cells": [{"name": "R0C1", "index": 0, "corners": [[0, 0], [1, 0], [1, 1], [0, 1]]}]}))
    r = readers.read_cells(spark, str(tmp_path / "grid")).first()
    assert (r["dish"], r["status"], r["cells"][0]["name"]) == (2, "pass", "R0C1")
    runs = tmp_path / "runs"
    runs.mkdir()
    for n in ("a.json", "b_sweep.json"):
        (runs / n).write_text("{}")
    assert readers.latest_run(spark, str(runs)).first()["path"].endswith("a.json")
    files = readers.file_fingerprints(spark, str(runs / "a.json"))
    sha = files.first()["sha256"]
    assert gate.fingerprint_is(files, sha).first()["ok"] and not gate.fingerprint_is(files, "0").first()["ok"]


def test_writers_scrub(spark, tmp_path):
    df = spark.createDataFrame([(1, math.nan, [1.0, math.inf])], "k int, x double, v array<double>")
    r = writers.scrub(df).first()
    assert r["x"] is None and r["v"] == [1.0, None]
    writers.write_run(df, df, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "predictions")).first()["x"] is None
    for meta, predictions in (readers.read_run(spark, "run", str(tmp_path)), readers.read_run(spark, str(tmp_path / "run"))):
        assert meta.first()["k"] == 1 and predictions.columns == ["k", "x", "v"] and predictions.first()["v"] == [1.0, None]
    plan = predictions.where("k = 1").select("x")._jdf.queryExecution().toString()
    assert "EqualTo(k,1)" in plan and "ReadSchema: struct<k:int,x:double>" in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_run(spark, "absent", str(tmp_path))
    views = spark.createDataFrame([("r", 0.0, 1), ("t", 8.0, 2)], "mode string, hours double, row int")
    writers.write_views(views, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v")).where("mode = 't'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(mode" in back._jdf.queryExecution().toString()
    writers.write_report_csv(views, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_array_files_and_dispatch(spark, raw):
    path, a = raw
    cube = a[0].transpose(2, 0, 1).astype(np.float32)
    np.save(path / "capture.npy", cube)
    got = {(r["line"], r["row"]): r["bands"] for r in lines.load_input(spark, str(path / "capture.npy"), 4, 6).collect()}
    assert got[(2, 3)] == cube[3, 2].tolist() and len(got) == 12
    assert lines.load_input(spark, str(path / "raw"), 4, 6).count() == 40
    with pytest.raises(Exception, match="is not"):
        lines.load_input(spark, str(path / "capture.npy"), 5, 6).collect()
