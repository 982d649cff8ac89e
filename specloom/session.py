"""Session helpers shared by tests, the bench and stand-alone jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches, with a folder of its own for checkpoints unless
    ``spark__checkpoint__dir`` names one; clusters bring their own session."""
    conf.setdefault("spark__checkpoint__dir", f"file://{tempfile.mkdtemp(prefix='specloom-ckpt-')}")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("specloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; a session without one is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Write a small, expensive intermediate once and go on from the files.

    A reliable checkpoint in the shared folder: losing executors later does not bring
    back the scan behind it, and the plans built on top stay short.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a large intermediate as Parquet into the shared folder and go on from its columns.

    Unlike a checkpoint it is read column by column.  The files go with the session.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/specloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
