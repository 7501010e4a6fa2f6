"""Counts under retraction: every change is a signed row, and statistics follow from the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.operators import counts as C


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Gram counts of some documents, added (1) or taken back (-1)."""
    return C.ngram_counts(rows).withColumns({"c": F.col("c") * sign, "w": F.col("w") * sign})


def applied(*changes: DataFrame) -> DataFrame:
    """Gram counts after all changes; grams that are gone have no row."""
    every = changes[0]
    for one in changes[1:]:
        every = every.unionByName(one)
    return every.groupBy("corpus", "n", "ngram", "ctx", "back").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).filter("c <> 0")


def update(counted: DataFrame, old: DataFrame, new: DataFrame, order: int) -> DataFrame:
    """Counts after documents changed from old to new tokens: the same as counting the final documents."""
    return applied(counted, signed(C.grams(old, order), -1), signed(C.grams(new, order), 1))
