"""Incremental dataset build: only changed captures are read, stale ones leave, a broken build changes nothing."""

import pathlib

import pytest
from pyspark.sql import functions as F

from specloom.plans import build as V
from specloom.plans import build_queries as Q
from specloom.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).is_dir(), reason="shared tables not present")


def test_incremental_build(spark, tmp_path):
    t, out = Tables(spark, FOLDER), str(tmp_path / "set")
    captures, cells, masks = Q.tables(t)
    number = F.substring("capture", 4, 9).cast("int")
    captures = captures.select(
        "*", F.lit("reflectance").alias("mode"), (number + 1).alias("day"), (-number + 9).alias("dish"), F.lit("dorsal").alias("side"), F.lit("f0").alias("fingerprint")
    )
    Q.cube(t).write.partitionBy("capture").parquet(str(tmp_path / "cube"))
    cube = spark.read.parquet(str(tmp_path / "cube"))
    first = V.build_views(spark, out, captures, cells, masks, cube, Q.SETTINGS)
    assert {(r["capture"], r["run"], r["n_views"]) for r in first.collect()} == {("cap0", 0, 6), ("cap1", 0, 6), ("cap2", 0, first.where("capture = 'cap2'").first()["n_views"])}
    want = {(r["capture"], r["ann_id"]): r for r in Q.build_views(t).collect()}
    views, pixels = V.read_built(spark, out)
    rows = views.orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(len(rows))) and {(r["capture"], r["ann_id"]) for r in rows} == set(want)
    assert [r["capture"] for r in rows] == sorted(r["capture"] for r in rows)
    assert all(round(r["nan_frac"], 6) == want[r["capture"], r["ann_id"]]["nan_frac"] for r in rows)
    n = Q.CELL_ROWS * Q.CELL_LINES
    assert pixels.count() == n * len(rows)

    # the same again, in another order of rows: nothing is rebuilt, and no pixel can be read
    for f in (tmp_path / "cube").glob("capture=*/*.parquet"):
        if "cap1" not in str(f):
            f.write_bytes(b"unreadable")
    for f in (tmp_path / "cube").glob("capture=*/.*.crc"):
        f.unlink()
    again = V.build_views(spark, out, captures, cells.orderBy(F.desc("name")), masks, cube, Q.SETTINGS)
    assert {r["run"] for r in again.collect()} == {0}

    # one capture's masks change, one capture leaves: the other is neither read nor rebuilt
    moved = masks.withColumn("counts", F.when(F.col("capture") == "cap1", F.transform("counts", lambda x, i: x + F.when(i == 0, -1).when(i == F.size("counts") - 1, 1).otherwise(0))).otherwise(F.col("counts")))
    left = captures.where("capture <> 'cap2'")
    new = V.build_views(spark, out, left, cells, moved, cube, Q.SETTINGS)
    assert {(r["capture"], r["run"]) for r in new.collect()} == {("cap0", 0), ("cap1", 2)}
    views, pixels = V.read_built(spark, out)
    assert views.groupBy("capture").count().count() == 2 and views.count() == 12 and pixels.count() == 12 * n
    old = {r["ann_id"]: r["spectrum"] for r in rows if r["capture"] == "cap1"}
    assert any(r["spectrum"] != old[r["ann_id"]] for r in views.where("capture = 'cap1'").collect())

    # a fatal problem refuses the build and leaves the dataset as it was
    bad = masks.withColumn("counts", F.when(F.col("capture") == "cap1", F.array(F.lit(720))).otherwise(F.col("counts")))
    with pytest.raises(ValueError, match="EMPTY_MASK x 6"):
        V.build_views(spark, out, left, cells, bad, cube, Q.SETTINGS)
    assert {(r["capture"], r["run"]) for r in V.manifest(spark, out).collect()} == {("cap0", 0), ("cap1", 2)}
    assert V.read_built(spark, out)[0].count() == 12
