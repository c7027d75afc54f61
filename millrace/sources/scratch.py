"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, only where that is unset and Spark runs in this process, a new local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{scratch_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; else these stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there, read back: lineage ends there, and no executor's loss can undo it. It goes when Spark ends, or by ``dropped``.

    The write leaves no shuffle files, and no mark of success: for such a file the driver starts a child, which counts the driver's memory once more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with swept(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression="zstd")
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(hadoop).deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
