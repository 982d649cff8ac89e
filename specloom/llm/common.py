"""Helpers of this subpackage: tables, shared folders, staged tables, Arrow row builders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="specloom-shared-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes with the session."""
    path = f"{shared_folder(spark)}/specloom-{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder once and go on from its files.

    The files outlive lost executors, so nothing before them runs again. They go with the session.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text is empty. Other columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


LOWEST = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and a key of two columns that is never null: the id, and a hash of the text.

    Rows with the same id stay apart unless they have the same text too.
    """
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LOWEST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches one by one; a batch is turned to Python objects a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def texts(batches: Iterable[pa.RecordBatch], column: str = "text", key: str = "doc_id") -> Iterator[tuple[int | None, bytes]]:
    """Pairs of id and the text's UTF-8 bytes, without decoding."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
        held = batch.column(batch.schema.get_field_index(column))
        for at, i in enumerate(ids):
            value = held[at].as_buffer()
            yield i, b"" if value is None else value.to_pybytes()


class Rows:
    """Collects rows and hands out Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.held, self.size = [[] for _ in schema], 0

    def add(self, *values, weight: int = 64) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.held, values, strict=True):
            column.append(value)
        self.size += weight
        if len(self.held[0]) >= self.most or self.size >= self.most_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.held, self.schema, strict=True)], schema=self.schema)
            self.held, self.size = [[] for _ in self.schema], 0
