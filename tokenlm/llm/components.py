"""Connected components of a graph given as a table of links, by large and small stars.

Every round joins vertices to the smallest neighbour they have, until the links form stars whose centre is their component's
smallest vertex, that is until no vertex has two centres or is a centre and a leaf. Rounds are written to the shared folder;
nothing but the answer to that question comes to the driver. Minima are pre-aggregated and written, and links go back to them by joins of two tables that Spark can split
where a hub has many links (adaptive skew joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.llm.session import written

#: Far more rounds than any graph that fits the machines needs (their number grows with the logarithm of its size).
MAX_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")


def _small(links: DataFrame) -> DataFrame:
    least = written(links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "least")
    moved = links.join(least, F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("u").alias("y"))).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _settled(links: DataFrame) -> bool:
    """Whether links (a < b) are stars: each b has one a, and no a is another link's b."""
    ends = links.select(F.col("b").alias("v"), F.lit(1).alias("leaf")).union(links.select("a", F.lit(0)).distinct())
    return ends.groupBy("v").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least")).filter("leaves > 1 OR (leaves = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: vertex and root, for every vertex with a link to another; root is the smallest vertex."""
    now = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = 0
    while not _settled(now):
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"links have not settled after {MAX_ROUNDS} rounds")
        now = written(_small(written(_large(now).distinct(), "large")).distinct(), "stars")
        rounds += 1
    roots = now.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("vertex"), F.col("a").alias("root")).distinct())
