"""Readers for annotations, plate fits, labels, clocks, folds and runs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import capture_key, coerce_day, column_index, column_letters, is_unscored
from ..operators.ordered import null_safe_join
from ..operators.select import exclude
from ..operators.timing import attach_clock
from . import schemas


def _fail(message: str, what) -> F.Column:
    return F.raise_error(F.concat(F.lit(message), what.cast("string")))


def read_views(spark: SparkSession, path: str, excluded: Sequence[int] = (2,), include_excluded: bool = False) -> DataFrame:
    """The view index with declared types; excluded strata are dropped in this one place."""
    views = spark.read.schema(schemas.VIEWS).option("header", True).option("mode", "FAILFAST").csv(path)
    return exclude(views, "variety", excluded, include_excluded)


def with_clock(views: DataFrame, clock: DataFrame) -> DataFrame:
    return attach_clock(views, clock, ["mode", "day_folder", "dish", "side"])


def read_timing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clock per capture, t0 per dish, visit hours per dish) from the timing document."""
    doc = spark.read.schema(schemas.TIMING).option("multiLine", True).json(path)
    caps = doc.select(F.explode("captures").alias("k", "v"))
    part = lambda i: F.split_part("k", F.lit("|"), F.lit(i))
    clock = caps.select(
        part(1).alias("mode"), part(2).cast("int").alias("day_folder"), part(3).cast("int").alias("dish"), part(4).alias("side"),
        F.col("v.time").alias("time"), F.col("v.hours").alias("hours"), F.col("v.source").alias("source"),
    )
    t0 = doc.select(F.explode("t0_by_dish").alias("dish", "t")).select(
        F.col("dish").cast("int").alias("dish"), F.to_timestamp("t").alias("t0")
    )
    visits = doc.select(F.explode("visits_by_dish").alias("dish", "v")).select(
        F.col("dish").cast("int").alias("dish"), F.transform("v", lambda x: x["hours"]).alias("visits")
    )
    return clock, t0, visits


def read_coco(spark: SparkSession, path: str, days: Sequence[int] | None = None) -> DataFrame:
    """One row per annotation with its capture key; rules of the export are enforced.

    The only category is KERNEL, run lengths are uncompressed, a capture appears once.
    Captures outside ``days`` and captures without annotations drop out.
    """
    doc = spark.read.schema(schemas.COCO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.forall("categories", lambda c: c["name"] == "KERNEL")
    doc = doc.withColumn("images", F.when(ok, F.col("images")).otherwise(
        _fail("unexpected categories: ", F.to_json("categories")).cast(doc.schema["images"].dataType)))
    images = doc.select(F.inline("images")).select(
        F.col("id").alias("image_id"), capture_key("file_name").alias("k"), F.col("height").alias("h"), F.col("width").alias("w")
    ).where("k IS NOT NULL").select("image_id", "k.*", "h", "w")
    if days is not None:
        images = images.where(F.col("day").isin(list(days)))
    key = ["mode", "day", "dish", "side"]
    once = images.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"), F.min("image_id").alias("image_id"), F.min("h").alias("h"), F.min("w").alias("w")
    )
    once = once.withColumn("image_id", F.when(F.col("__n") == 1, F.col("image_id")).otherwise(
        _fail("capture annotated twice: ", F.concat_ws("/", *[F.col(c).cast("string") for c in key])).cast("int"))).drop("__n")
    anns = doc.select(F.posexplode("annotations").alias("ann_pos", "a")).select(
        "ann_pos", F.col("a.id").alias("ann_id"), F.col("a.image_id").alias("image_id"), F.col("a.area").alias("area"),
        F.col("a.bbox").alias("bbox"), F.col("a.segmentation.counts").alias("counts"), F.col("a.segmentation.size").alias("size"),
    )
    return anns.join(once, "image_id")


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Every fitted plate below ``root``: one row per capture, cells nested."""
    doc = spark.read.schema(schemas.CELLS).option("multiLine", True).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "cells.json").json(root)
    return doc.select("capture.*", *[c for c in doc.columns if c != "capture"])


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """(kernel_uid, first_day) of scored units; NULL = scored, never.

    Missing columns, empty or repeated uids and foreign tokens fail the job; unscored
    tokens leave no row.
    """
    raw = spark.read.option("header", True).csv(path)
    for column in ("kernel_uid", "first_germinated_day"):
        if column not in raw.columns:
            raise ValueError(f"no column {column}; got {raw.columns}")
    uid = F.trim(F.coalesce("kernel_uid", F.lit("")))
    rows = raw.select(
        F.when(uid != "", uid).otherwise(F.raise_error(F.lit("a row has an empty kernel_uid"))).alias("kernel_uid"),
        F.col("first_germinated_day").alias("raw"),
    ).where(~is_unscored("raw"))
    once = rows.groupBy("kernel_uid").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
    raw_once = F.when(F.col("n") == 1, F.col("raw")).otherwise(_fail("labelled twice: ", F.col("kernel_uid")))
    return once.select("kernel_uid", coerce_day(raw_once).alias("first_day"))


def _sheet_cells(content: bytes) -> list[tuple[int, str, str]]:
    """(row, cell reference, text) of the first worksheet; blank cells are absent."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{ns}t")))
        first = min(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        out = []
        for c in ElementTree.fromstring(z.read(first)).iter(f"{ns}c"):
            v = c.find(f"{ns}v")
            text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if v is None else v.text
            if c.get("t") == "s" and v is not None:
                text = shared[int(v.text)]
            if text not in (None, ""):
                out.append((int(re.sub(r"\D", "", c.get("r"))), c.get("r"), text))
        return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet cells as (path, row, col, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                got = _sheet_cells(content)
                yield pd.DataFrame({"path": p, "row": [g[0] for g in got], "ref": [g[1] for g in got], "text": [g[2] for g in got]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(run, "path string, row int, ref string, text string")
    return cells.select("path", "row", column_index(column_letters("ref")).alias("col"), "text")


def read_label_grid(cells: DataFrame, n_wells: int = 22, n_groups: int = 25) -> DataFrame:
    """Unpivot the dish x well sheet to (dish, cell_index, first_day).

    The header must name the wells 0..n_wells-1 once each, in any order; columns under other
    heads, such as notes, hold no labels.  Each dish must appear once and lie in range.
    """
    number = F.col("text").try_cast("double")
    heads = cells.where("row = 1 AND col > 0").where(number == F.floor(number)).select("col", number.cast("int").alias("well"))
    named = heads.agg(F.array_sort(F.collect_list("well")).alias("h"))
    good = named.select(F.when(F.to_json("h") == F.to_json(F.sequence(F.lit(0), F.lit(n_wells - 1))), True).otherwise(
        F.raise_error(F.lit("the header is not the expected well numbers")).cast("boolean"))).scalar()
    dishes = cells.where("row > 1 AND col = 0").select("row", F.col("text").try_cast("double").cast("int").alias("dish"))
    once = dishes.groupBy("dish").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    fine = (F.col("n") == 1) & F.col("dish").between(0, n_groups - 1)
    once = once.select("row", F.when(fine, F.col("dish")).otherwise(_fail("bad or repeated dish: ", F.coalesce(F.col("dish"), F.lit(-1))).cast("int")).alias("dish"))
    body = cells.where("row > 1 AND col > 0").where(~is_unscored("text")).withColumn("__ok", good)
    out = body.join(once, "row").join(heads, "col").where("__ok")
    return out.select("dish", F.col("well").alias("cell_index"), coerce_day("text").alias("first_day"))


def grid_to_labels(grid: DataFrame, all_views: DataFrame) -> DataFrame:
    """Well positions to unit ids, using the unfiltered view index.

    A scored well that no view knows fails the job.
    """
    wells = all_views.select("dish", "cell_index", "kernel_uid").distinct()
    out = null_safe_join(grid, wells, ["dish", "cell_index"], "left")
    name = F.concat_ws("/", F.col("dish").cast("string"), F.col("cell_index").cast("string"))
    uid = F.when(F.col("kernel_uid").isNotNull(), F.col("kernel_uid")).otherwise(_fail("scored well without a unit: ", name))
    return out.select(uid.alias("kernel_uid"), "first_day")


def check_labels(labels: DataFrame, units: DataFrame, empty_wells: Sequence[str]) -> DataFrame:
    """Labels unchanged, or a failed job: no label on a known empty well, none without a unit."""
    out = labels.join(units.select("kernel_uid", F.lit(True).alias("__hit")).distinct(), "kernel_uid", "left")
    bad = F.col("__hit").isNull() | F.col("kernel_uid").isin(list(empty_wells))
    uid = F.when(bad, _fail("label without a unit: ", F.col("kernel_uid"))).otherwise(F.col("kernel_uid"))
    return out.select(uid.alias("kernel_uid"), "first_day")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(kernel_uid, fold): the fold each unit is held out in."""
    doc = spark.read.schema(schemas.SPLITS).option("multiLine", True).json(path)
    return doc.select(F.posexplode("folds").alias("fold", "f")).select(F.explode("f.test").alias("kernel_uid"), "fold")


def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run record that is no sweep, by file time: (path, modificationTime)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    runs = files.where(~F.col("path").endswith("_sweep.json")).select("path", "modificationTime")
    return runs.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def read_run(spark: SparkSession, run: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(record, predictions) of a written run, named by its path or by its bare name below ``folder``.

    Both are lazy; columns and filters of the predictions reach their Parquet files.
    """
    path = f"{folder}/{run}" if folder is not None and "/" not in run else run
    return spark.read.json(f"{path}/meta"), spark.read.parquet(f"{path}/predictions")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
