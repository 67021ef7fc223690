"""Shared scratch tables: lineage is cut by writing Parquet in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch: bounds the memory of a Python worker at a few MB of text for usual documents.
BATCH_ROWS = 512
#: Bytes per Arrow batch, where rows are long.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only on a local master where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallyforge/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches to Python hold that many rows at most; Python workers find this package where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def frugal(run: Callable[[Iterator], Iterator], at_once: bool = True) -> Callable[[Iterator], Iterator]:
    """run(batches), in a worker that gives memory back when the task ends, and that of large arrays at once if at_once.

    Python workers outlive their tasks, so what the allocator holds would count beside all that runs later.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            libc = ctypes.CDLL("libc.so.6")
            if at_once:
                libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            trim = libc.malloc_trim
        except (OSError, AttributeError):  # another C library
            trim = None
        yield from run(batches)
        if trim:
            trim(0)

    return wrapped
