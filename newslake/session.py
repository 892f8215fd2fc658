"""Session settings and the shared work folder every multi-step operator uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


_LOCAL_ROOTS: dict[str, str] = {}  # per local application


BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20  # that cross to Python at a time


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Sizes and parallelism stay the cluster's own.

    A Python worker holds a batch as it came and what it makes of it, several times its size, so batches are small.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """One task per core for a table that arrives in fewer splits than there are cores.

    Text work is bound by the processor, so a small table in one file would keep one core busy. A table
    with enough splits, as any large one, passes unchanged and unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def work_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream state.

    It is the folder named by ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because on a cluster other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="newslake-")
    return _LOCAL_ROOTS[app]


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_RUN.get() or work_root(spark)}/newslake-{label}-{uuid.uuid4().hex}"


@contextmanager
def work_of_a_run(spark: SparkSession, label: str) -> Iterator[str]:
    """Work folders made inside lie in one folder, which goes when the block ends: its result is written by then."""
    folder = new_folder(spark, label)
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _located(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _located(spark, path)
    files.delete(place, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    A written table survives the loss of executors, is computed once (an eager reliable checkpoint
    computes its last stage twice), gives row counts from file footers and real sizes to the optimizer.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, label: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once, and to be broadcast if what was written is below ``limit`` bytes; else a plain table."""
    written = materialise(df, label)
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(written) if size <= limit else written
