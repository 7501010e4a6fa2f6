"""Ranks and running sums in an order that no single task holds.

A range sort deals the rows to parts, each part counts its own, and the parts' totals, a row each, say where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.sources.shared import written


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], value: Column | str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same by up to this one, in the order given; ties in any order.

    rows have no columns named sort_place, sort_part, sort_start, sort_inside, or order0 and so on."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"order{i}" for i in range(len(order))]
    keyed = rows.withColumns({name: F.col(o) if isinstance(o, str) else o for name, o in zip(names, order, strict=True)})
    sorted_rows = keyed.repartitionByRange(n, *by, *names).sortWithinPartitions(*by, *names).drop(*names)
    placed = written(sorted_rows.withColumn("sort_place", F.monotonically_increasing_id()), "ordered").withColumn("sort_part", F.shiftright("sort_place", 33))
    value = F.col(value) if isinstance(value, str) else value
    totals = placed.groupBy(*by, "sort_part").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(*by).orderBy("sort_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "sort_part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("sort_start"))
    inside = Window.partitionBy(*by, "sort_part").orderBy("sort_place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("sort_inside", F.sum(value).over(inside)).join(starts, [*by, "sort_part"]).withColumn(out, F.col("sort_start") + F.col("sort_inside")).drop("sort_part", "sort_place", "sort_inside", "sort_start")
