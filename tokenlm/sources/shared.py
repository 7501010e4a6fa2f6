"""Tables that cut a plan's lineage, in the folder that the cluster shares, the size of batches that go to Python, and its free memory."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that goes to Python. Batches otherwise hold 10,000 texts, however long.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster's tasks
    and driver would each write to a disk of their own, so there it is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        found = tempfile.mkdtemp(prefix="tokenlm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again, so that what follows plans and recovers from the table alone."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles are removed as soon as the table is written that they were made for, not when the driver collects its garbage."""
    now = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if now is None else spark.conf.set(_CLEANUP, now)


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on batches to BATCH_BYTES, unless it is lower; a single longer row is a batch of its own."""
    now = str(spark.conf.get(_SETTING)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # finding the library by name starts processes
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, and then release: the worker of a task that has ended stays, and other workers need its memory."""

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return out
