"""Tables of a run, the shared folder for tables that cut a plan's lineage, and the size of batches that go to Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tokenlm.sources.shared import bounded, shared_dir, tidy, written

__all__ = ["bounded", "local_rows", "shared_dir", "table", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's own columns. From rows, Spark would make it in Python workers of another kind, whose parent process
    then stays beside the one of the text kernels in every executor."""
    return spark.createDataFrame(pa.table(columns))
