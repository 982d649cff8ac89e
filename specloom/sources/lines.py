"""Raw camera lines: packed 12-bit files to rows of one spectrum per spatial pixel."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import capture_key, line_stamp

# Sensor geometry.
WIDTH, CHANNELS = 640, 224
LINE_BYTES = WIDTH * CHANNELS * 3 // 2


def unpack12(raw: bytes) -> np.ndarray:
    """Two 12-bit counts from every three bytes (high byte first, shared middle byte)."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int16)
    return np.column_stack([(b[:, 0] << 4) | (b[:, 1] >> 4), (b[:, 2] << 4) | (b[:, 1] & 15)]).ravel()


def line_number(name: Column) -> Column:
    """Number of a line from its file name, the digits before the first underscore; NULL without.

    Batch and stream number alike: a lost line leaves a gap instead of moving those after it.
    """
    return F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int")


def line_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(capture, name, line, stamp, content): one row per line file below ``folder`` (or several)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(folder)
    )
    cut = F.col("path")
    return files.select(
        F.regexp_extract(cut, r"^(.*)/[^/]+$", 1).alias("capture"),
        F.regexp_extract(cut, r"([^/]+)$", 1).alias("name"),
        line_number(F.regexp_extract(cut, r"([^/]+)$", 1)).alias("line"),
        line_stamp(F.regexp_extract(cut, r"([^/]+)$", 1)).alias("stamp"),
        "content",
    )


def number_lines(files: DataFrame) -> DataFrame:
    """Files with a line number; one whose name gives none, or repeats another's, fails the job.

    Only names are grouped, a few thousand per capture; contents are never shuffled.
    """
    named = files.withColumn("line", F.coalesce("line", F.raise_error(F.concat(F.lit("no line number: "), F.col("name"))).cast("int")))
    twice = files.groupBy("capture", "line").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    return named.withColumn("line", F.when(F.coalesce(twice, F.lit(1)) == 1, F.col("line")).otherwise(F.raise_error(F.lit("a line number occurs twice")).cast("int")))


def whole_capture(spark: SparkSession, path: str, line_bytes: int = LINE_BYTES) -> DataFrame:
    """Cut concatenated capture files into lines; a ragged file fails the job.

    The format holds a capture in one file, so one task holds one capture (0.5 to 0.7 GB).
    """
    files = spark.read.format("binaryFile").load(path)
    whole = F.when(F.length("content") % line_bytes == 0, (F.length("content") / line_bytes).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of lines: "), F.col("path"))).cast("int")
    )
    cut = files.select(F.col("path").alias("capture"), "content", F.explode(F.sequence(F.lit(0), whole - 1)).alias("line"))
    return cut.select("capture", "line", F.substring("content", F.col("line") * line_bytes + 1, F.lit(line_bytes)).alias("content"))


def unpack_lines(lines: DataFrame, width: int = WIDTH, channels: int = CHANNELS) -> DataFrame:
    """(capture, line, row, bands, blank): one row per spatial pixel of every line.

    Bands are the slow axis of a file and the spatial axis is mirrored.  A line of the
    wrong size, or of zeros only, becomes a zero line marked blank.
    """
    need = width * channels * 3 // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for capture, line, content in zip(pdf["capture"], pdf["line"], pdf["content"]):
                ok = content is not None and len(content) == need
                frame = unpack12(content).reshape(channels, width) if ok else np.zeros((channels, width), np.int16)
                yield pd.DataFrame(
                    {
                        "capture": capture, "line": line, "row": np.arange(width), "bands": list(frame.T[::-1]),
                        "blank": not frame.any(),
                    }
                )

    return lines.select("capture", "line", "content").mapInPandas(
        run, "capture string, line int, row int, bands array<smallint>, blank boolean"
    )


def stitch(spark: SparkSession, folder: str, width: int = WIDTH, channels: int = CHANNELS) -> DataFrame:
    """Line folders to a cube table, every file read once."""
    return unpack_lines(number_lines(line_files(spark, folder)), width, channels)


def blank_lines(cube: DataFrame) -> DataFrame:
    return cube.where("blank").select("capture", "line").distinct()


def discover(spark: SparkSession, root: str, pattern: str = "capture.npy", **wanted) -> DataFrame:
    """Captures below ``root`` as (mode, day, dish, side, path); filters are optional IN-lists.

    Only file metadata is read: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    found = files.select(capture_key("path").alias("k"), "path", "length", "modificationTime").where("k IS NOT NULL")
    out = found.select("k.*", "path", "length", "modificationTime")
    for column, values in wanted.items():
        if values is not None:
            out = out.where(F.col(column).isin(list(values)))
    return out.orderBy("mode", "day", "dish", "side")


def exactly_one(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per key, or the job fails naming the key."""
    got = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("path"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return got.select(
        *keys, F.when(F.col("__n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("ambiguous: "), name))).alias("path")
    )


def resolve_calibration(needs: DataFrame, found: DataFrame) -> DataFrame:
    """A day's own calibration before the shared one; ``scope`` says which was used.

    ``needs`` holds (day, what); ``found`` (day, what, path) with day NULL = shared.
    """
    own = found.where("day IS NOT NULL").select("day", "what", F.col("path").alias("__own"))
    shared = found.where("day IS NULL").select("what", F.col("path").alias("__shared"))
    out = needs.join(own, ["day", "what"], "left").join(shared, "what", "left")
    return out.select(
        "day", "what", F.coalesce("__own", "__shared").alias("path"),
        F.when(F.col("__own").isNotNull(), "day").when(F.col("__shared").isNotNull(), "shared").alias("scope"),
    )



def load_arrays(spark: SparkSession, path: str, width: int = WIDTH, channels: int = CHANNELS) -> DataFrame:
    """Stitched array files as (capture, line, row, bands); any other shape fails the job.

    The format holds a capture in one file, so one task holds one capture.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                cube = np.load(io.BytesIO(content), allow_pickle=False)
                if cube.ndim != 3 or (cube.shape[0], cube.shape[2]) != (width, channels):
                    raise ValueError(f"{name}: shape {cube.shape} is not ({width}, lines, {channels})")
                for line in range(cube.shape[1]):
                    yield pd.DataFrame(
                        {"capture": name, "line": line, "row": np.arange(width), "bands": list(cube[:, line].astype(np.float32))}
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "capture string, line int, row int, bands array<float>")


def load_input(spark: SparkSession, path: str, width: int = WIDTH, channels: int = CHANNELS) -> DataFrame:
    """A cube from a folder of lines, a concatenated file or a stitched array, by suffix."""
    if path.endswith(".npy"):
        return load_arrays(spark, path, width, channels)
    if path.endswith(".bin"):
        return unpack_lines(whole_capture(spark, path, width * channels * 3 // 2), width, channels)
    return stitch(spark, path, width, channels)
