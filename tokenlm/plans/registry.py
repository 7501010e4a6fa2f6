"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenlm.plans import counting, featuring, modelling, wording

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**counting.QUERIES, **featuring.QUERIES, **modelling.QUERIES, **wording.QUERIES}
SQL: dict[str, str] = {**counting.SQL, **featuring.SQL, **modelling.SQL, **wording.SQL}
