"""Splitting documents into ranges and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators.ordering import running_sums


def indexed(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Adds idx, the document's number from 0 by key, and n, how many there are, through per-range counts."""
    spread = docs.withColumn("cell", F.floor(F.col(key) / 1024))
    cells = spread.groupBy("cell").agg(F.count("*").alias("m"))
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("cell", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(key)) - 1
    return spread.join(starts, "cell").withColumn("idx", F.col("start") + inside).drop("cell", "start")


def bound(x: float, n):
    """A range's end as a number of documents: at most 1 in size is a share of n, and negatives count from the end."""
    v = F.lit(float(x))
    share = F.when(F.abs(v) <= 1, F.floor(v * n)).otherwise(F.floor(v))
    return F.when(share < 0, share + n).otherwise(share)


def range_flags(docs: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """A boolean column for each range [first, second) of document numbers."""
    rows = indexed(docs)
    return rows.select(*docs.columns, "idx", *[((F.col("idx") >= bound(a, F.col("n"))) & (F.col("idx") < bound(b, F.col("n")))).alias(name) for name, (a, b) in ranges.items()])


def supported(docs: DataFrame, least: int = 5) -> DataFrame:
    """Languages with at least so many documents."""
    return docs.groupBy("lang").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)


def split_flags(docs: DataFrame, share: float, count_on_tuned: bool = True, least: int = 5) -> DataFrame:
    """Per language the last floor((1 - share) * docs) + 1 documents are tuned, the one before them is the last counted one."""
    rows = running_sums(docs.join(supported(docs, least), "lang"), ["lang"], [-F.col("doc")], F.lit(1), "place")
    tuned = F.floor(F.round((1 - share) * F.col("docs"), 9)) + 1
    is_tune = F.col("place") <= tuned
    return rows.select(*docs.columns, is_tune.alias("is_tune"), (~is_tune | F.lit(count_on_tuned)).alias("is_count"), (F.col("place") == tuned + 1).alias("is_last_count"))


def tuning_period(docs: DataFrame, total: int) -> DataFrame:
    """docs: lang, doc, n_tokens of tuned documents. period: max(1, n_tokens / (total / tuned documents of the language))."""
    n = docs.groupBy("lang").agg(F.count("*").alias("tuned"))
    each = F.greatest(F.floor(F.lit(total) / F.col("tuned")), F.lit(1))
    return docs.join(n, "lang").select("lang", "doc", "n_tokens", F.greatest(F.lit(1), F.floor(F.col("n_tokens") / each)).cast("long").alias("period"))


def systematic(docs: DataFrame, period: int) -> DataFrame:
    """One of every period documents in order."""
    return indexed(docs).filter(F.col("idx") % period == 0).drop("n")


def permuted(docs: DataFrame, seed: int) -> DataFrame:
    """Documents with a key that orders them at random, the same for the same seed."""
    return docs.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"))))


def phases(docs: DataFrame, train: int, tune: int, test: int) -> DataFrame:
    """Phase of each document by the running number of tokens before it: train, tune, test, then none. docs: doc, n_tokens."""
    cells = docs.withColumn("cell", F.floor(F.col("doc") / 1024))
    totals = cells.groupBy("cell").agg(F.sum("n_tokens").alias("s"))
    starts = totals.select("cell", F.coalesce(F.sum("s").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("cell").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.col("before")
    return cells.join(starts, "cell").withColumn("before", F.col("start") + inside).select("doc", "n_tokens", "before", F.when(before < train, "train").when(before < train + tune, "tune").when(before < train + tune + test, "test").otherwise("none").alias("phase"))
