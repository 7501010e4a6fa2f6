"""Synthetic documents with power-law tokens w0, w1, ..."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shares(vocabulary: int, alpha: float) -> list[float]:
    """p(i) = (alpha - 1) (i + 1)^-alpha; token 0 takes what is left."""
    p = [(alpha - 1) * (i + 1) ** -alpha for i in range(vocabulary)]
    p[0] += 1 - sum(p)
    return p


def edges(vocabulary: int, alpha: float) -> list[float]:
    """Upper ends of the tokens' shares of [0, 1), but the last one's."""
    return list(accumulate(shares(vocabulary, alpha)))[:-1]


def power_law(spark: SparkSession, documents: int, length: int = 10, vocabulary: int = 100, bigram: bool = False, alpha: float = 2.0, seed: int = 1) -> DataFrame:
    """doc and pos from 1, and token. A cell's random number comes from a hash of seed, doc and pos.

    With bigram, the third token and every second one after it say how far back the token before lies (modulo the vocabulary).
    """

    def index(pos):
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"), pos.cast("string"))), 1, 10)
        u = F.conv(digits, 16, 10).cast("double") / float(1 << 40)
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges(vocabulary, alpha)]), lambda e: e <= u)).cast("long")

    cells = spark.range(documents * length).select((F.col("id") / length).cast("long").alias("doc"), (F.col("id") % length + 1).alias("pos"))
    i = index(F.col("pos"))
    if bigram:
        back = (index(F.col("pos") - 1) - i + vocabulary) % vocabulary
        i = F.when((F.col("pos") > 1) & (F.col("pos") % 2 == 1), back).otherwise(i)
    return cells.select("doc", "pos", F.concat(F.lit("w"), i.cast("string")).alias("token"))
