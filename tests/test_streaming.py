"""A drop folder with gaps, repeats, late lines and a restart gives the batch result."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.sources import lines
from specloom.streaming.captures import ingest_captures
from test_sources import pack

W, B, N = 4, 6, 5


@pytest.fixture()
def drop(spark, tmp_path):
    """Writes line files one by one and runs the stream until a release appears."""
    rng = np.random.default_rng(1)
    folder = tmp_path / "drop"
    folder.mkdir()

    def put(capture, *numbers, name="{:04d}_{:04x}_w4.bin"):
        (folder / capture).mkdir(exist_ok=True)
        for n in numbers:
            (tmp_path / "part").write_bytes(pack(rng.integers(1, 4096, (B, W))))
            (tmp_path / "part").rename(folder / capture / name.format(n, n * 16))

    def run(*wanted):
        def figures(raw):
            return {"quality": raw.groupBy("capture").agg(F.count_distinct("line").alias("lines"), F.sum(F.aggregate("bands", F.lit(0), lambda a, x: a + x)).alias("total"))}

        q = ingest_captures(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt"), N, 3.0, figures, W, B, "1 second")
        try:
            end = time.time() + 90
            while time.time() < end:
                if (got := listed()) and all(got.get(c, (0,))[0] >= r for c, r in wanted):
                    break
                assert q.exception() is None
                time.sleep(0.5)
        finally:
            q.stop()
        return listed()

    def listed():
        try:
            rows = spark.read.parquet(str(tmp_path / "out" / "releases")).collect()
        except Exception:  # nothing released yet, or just being replaced
            return {}
        return {r["capture"].rsplit("/", 1)[1]: (r["revision"], r["reason"], r["n_lines"], r["n_missing"], r["problem"]) for r in rows}

    return folder, tmp_path / "out", put, run


def same_as_batch(spark, folder, out, captures):
    want = lines.stitch(spark, [str(folder / c) for c in captures], W, B)
    got = spark.read.parquet(str(out / "raw")).select(want.columns)
    return want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_captures_are_released_whole_quiet_and_late(spark, drop):
    folder, out, put, run = drop
    put("whole", *range(N))
    put("gap", 0, 1, 3)
    put("twice", 0, 1, 2, 3, 4)
    put("twice", 4, name="{:04d}_again_w4.bin")
    got = run(("whole", 1), ("gap", 1), ("twice", 1))
    assert got["whole"] == (1, "complete", 5, 0, None)
    assert got["gap"] == (1, "quiet", 3, 2, None)
    assert got["twice"][4] == "a line number occurs twice"
    assert same_as_batch(spark, folder, out, ["whole", "gap"])
    before = spark.read.parquet(str(out / "quality")).where("capture LIKE '%/whole'").first()["total"]
    # after a restart: a line in the gap arrives late, another capture comes in two parts, nothing else moves
    put("gap", 2)
    put("parts", 3, 0)
    put("odd", 0, name="line_{:d}.bin")
    (folder / "twice" / "0004_again_w4.bin").unlink()
    put("twice", 5)
    got = run(("gap", 2), ("parts", 1), ("odd", 1), ("twice", 2))
    assert got["twice"] == (2, "late", 6, 0, None)
    assert got["gap"] == (2, "late", 4, 1, None) and got["parts"] == (1, "quiet", 2, 3, None)
    assert got["odd"][4] == "a line without a number" and got["whole"] == (1, "complete", 5, 0, None)
    assert same_as_batch(spark, folder, out, ["whole", "gap", "parts", "twice"])
    quality = {r["capture"].rsplit("/", 1)[1]: r for r in spark.read.parquet(str(out / "quality")).collect()}
    assert quality["gap"]["lines"] == 4 and quality["whole"]["total"] == before and set(quality) == {"whole", "gap", "parts", "twice"}
