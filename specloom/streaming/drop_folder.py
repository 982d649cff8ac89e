"""Drop-folder ingest: line files appear, are unpacked and committed once.

The batch tool watches a folder, processes what it finds and clears the input last.
Here a file stream tracks what was seen in its checkpoint, so nothing is deleted before
its batch is committed, and a replayed batch overwrites its own output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import CHANNELS, WIDTH, line_number, number_lines, unpack_lines


def file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """(capture, name, content) of line files as they arrive; contents that are not selected are not read."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.bin")
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(folder).select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("capture"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"
    )


def watch_lines(spark: SparkSession, folder: str) -> DataFrame:
    return file_stream(spark, folder).select("capture", "name", line_number(F.col("name")).alias("line"), "content")


def ingest(
    spark: SparkSession, folder: str, out: str, checkpoint: str, width: int = WIDTH, channels: int = CHANNELS
) -> StreamingQuery:
    """Unpack arriving lines into ``out``/batch=<n>; runs until the folder is drained."""

    def commit(batch: DataFrame, number: int) -> None:
        unpack_lines(number_lines(batch), width, channels).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        watch_lines(spark, folder)
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
