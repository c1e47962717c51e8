"""Intermediate tables that driver and executors share, so that a lost executor costs no lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session without a cluster may do without it, and
    gets a folder of its own: there the driver's disk is the executors' too."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="symtrail-checkpoints-"))
        folder = context.getCheckpointDir()
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Survives lost executors, unlike a local checkpoint, and stays small on disk as it is columnar.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins never send through the driver. Spark takes the size of Parquet for that of its
    rows, though repeated strings can be fifty times larger in memory."""
    return df.hint("merge")


def drop_scratch() -> None:
    """Delete every table that materialise() wrote; results not yet computed from them are lost."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        drop_scratch()
