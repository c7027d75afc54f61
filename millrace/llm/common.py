"""Helpers that several operators share: scratch tables, hashed splits and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word: blank and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, only where that is unset and Spark runs in this process, a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder; what is written there goes when Spark ends."""
    path = f"{scratch_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and no executor's loss can undo it. It goes when Spark ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """df, in a session whose Arrow batches of rows hold ``size`` bytes at most: batches of 10,000 whole texts fill an executor's memory several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not given or not 0 < int(given[1]) <= size:
        conf.set(name, f"{size}b")
    return df


def runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows of such sizes in runs of about ``most`` together, one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def in_groups(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Texts in runs of about ``most`` bytes, one text at least."""
    for cut in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), most):
        yield texts[cut]


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores where its files give fewer: a file of one row group is a single task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the column's text modulo modulus; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def blocks(rows: int, size: int) -> int:
    """How many blocks of about size rows hold that many rows; at least one."""
    return max(1, -(-int(rows) // size))


def wide(spark: SparkSession, least: int = 1) -> int:
    """A partition count for an explicit repartition: that of shuffles, and no less than least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
