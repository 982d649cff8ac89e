"""From drop folder to corrected capture: a capture is released when it is whole or has gone quiet.

The stream carries names only.  What was seen of a capture is a bitmap of its line numbers, some
hundred bytes of state; contents are read once, from the folders of the captures a batch releases.

* A capture is released as ``complete`` when it has the expected number of lines, as ``quiet`` when
  no line came for a while (lines may be missing), and again as ``late`` by every batch that brings
  lines after that; the last release holds, so the end result is that of a batch run.
* Names without a number, and numbers that two files share, make a release with a problem: it is
  listed, and nothing of the capture is unpacked until its folder is mended and a line arrives anew.
  Problems and gaps are counted in the folder as it lies there, as a batch run would.
* A batch that is run again writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import settle
from ..sources.lines import CHANNELS, WIDTH, line_files, line_number, unpack_lines
from .drop_folder import file_stream

RELEASE = "capture string, revision int, reason string"
#: state is kept by this store, on local disk with changes in the query's checkpoint folder
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Release(StatefulProcessor):
    """Keeps each capture's bitmap of lines and says when the capture is to be worked on."""

    def __init__(self, expected: int | None, quiet_ms: int):
        self.expected, self.quiet_ms = expected, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "bits binary, revision int")

    def load(self) -> tuple[int, int]:
        if not self.seen.exists():
            return 0, 0
        bits, revision = self.seen.get()
        return int.from_bytes(bits, "little"), revision

    def store(self, bits: int, revision: int) -> None:
        self.seen.update((bits.to_bytes((bits.bit_length() + 7) // 8, "little"), revision))

    def released(self, key, bits: int, revision: int, reason: str) -> pd.DataFrame:
        self.store(bits, revision)
        return pd.DataFrame({"capture": [key[0]], "revision": [revision], "reason": [reason]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bits, revision = self.load()
        for pdf in rows:
            for line in pdf["line"].dropna():
                bits |= 1 << int(line)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if revision:
            yield self.released(key, bits, revision + 1, "late")
        elif self.expected and bits.bit_count() >= self.expected:
            yield self.released(key, bits, 1, "complete")
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
            self.store(bits, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bits, revision = self.load()
        yield self.released(key, bits, revision + 1, "quiet")


def releases(names: DataFrame, expected: int | None, quiet_ms: int) -> DataFrame:
    """Releases of a stream of (capture, line); without ``expected`` lines only quiet captures are released."""
    return names.select("capture", "line").groupBy("capture").transformWithStateInPandas(
        Release(expected, quiet_ms), RELEASE, "append", "ProcessingTime"
    )


def work_folders(
    spark: SparkSession, released: DataFrame, out: str, expected: int | None, width: int, channels: int,
    correct: Callable[[DataFrame], dict[str, DataFrame]] | None,
) -> None:
    """Unpack and correct the released captures; each table below ``out`` is replaced capture by capture.

    The folders of one batch are named to the reader, as many as its files at most. The release itself
    is written last: a capture listed there without a problem has all its tables.
    """
    last = released.groupBy("capture").agg(F.max_by(F.struct("*"), "revision").alias("r")).select("r.*")
    folders = [r["capture"] for r in last.select("capture").collect()]
    found = line_files(spark, folders).groupBy("capture").agg(
        F.count_distinct("line").cast("int").alias("n_lines"), F.max("line").alias("last_line"),
        F.count_if(F.col("line").isNull()).alias("n_unnumbered"), (F.count("line") - F.count_distinct("line")).alias("n_repeated"),
    )
    problem = F.when(F.col("n_unnumbered") > 0, "a line without a number").when(F.col("n_repeated") > 0, "a line number occurs twice")
    whole = F.greatest(F.lit(expected or 0), F.col("last_line") + 1)
    listed = settle(last.join(found, "capture").withColumns({"n_missing": whole - F.col("n_lines"), "problem": problem}))
    folders = [r["capture"] for r in listed.where("problem IS NULL").select("capture").collect()]
    replace = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture").parquet(f"{out}/{name}")
    if folders:
        replace(unpack_lines(line_files(spark, folders), width, channels), "raw")
        if correct is not None:
            raw = spark.read.parquet(f"{out}/raw").where(F.col("capture").isin(folders))
            for name, table in correct(raw).items():
                replace(table, name)
    replace(listed, "releases")


def ingest_captures(
    spark: SparkSession, folder: str, out: str, checkpoint: str, expected: int | None = None, quiet: float = 600.0,
    correct: Callable[[DataFrame], dict[str, DataFrame]] | None = None, width: int = WIDTH, channels: int = CHANNELS,
    every: str = "10 seconds", files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Watch ``folder`` and keep ``out``/raw, the tables of ``correct`` and ``out``/releases up to date.

    ``correct`` takes the unpacked lines (capture, line, row, bands, blank) of whole captures and returns
    named tables with a ``capture`` column. ``quiet`` is in seconds. Runs until stopped, as timers need
    batches; the session must keep its state in ``STORE``.
    """
    names = file_stream(spark, folder, files_per_batch).select("capture", line_number(F.col("name")).alias("line"))

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                work_folders(batch.sparkSession, batch, out, expected, width, channels, correct)
        finally:
            batch.unpersist()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return (
        releases(names, expected, int(quiet * 1000))
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
