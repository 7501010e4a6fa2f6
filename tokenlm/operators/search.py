"""Multi-token completions: bounded rounds of expansion, each a join of the frontier with the next-token table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.functions.scalars import has_base

#: Defaults: least probability of a path, children of a path, single tokens shown, and rounds.
THRESHOLD, BRANCHING, MIN_SIZE, DEPTH = 0.1, 5, 50, 4


def paths(starts: DataFrame, following: DataFrame, stop: DataFrame | None = None, threshold: float = THRESHOLD, branching: int = BRANCHING, depth: int = DEPTH, base: str = "", least: int = 0) -> DataFrame:
    """ctx_id, path (tokens joined by a space), prob, length and exclusive_prob (prob less that of its children).

    starts: ctx_id, corpus, last. following: corpus, last, token, p. stop: ctx_id, token that is right of the cursor: it is
    never added after the first token. A path is kept while its probability is at least the threshold, so depth is bounded.
    base: first tokens start with it, and their probabilities are among those that do. least: first tokens under the threshold
    are shown, but not followed, until there are so many. Paths that go on are dealt fewer children the less likely they are:
    a child's own probability must reach the threshold over its path's.
    """
    best = Window.partitionBy("ctx_id", "path").orderBy(F.desc("next"), "token")
    front = starts.select("ctx_id", "corpus", "last", F.lit("").alias("path"), F.lit(1.0).alias("prob"), F.lit(0).alias("length"))
    found = None
    for k in range(depth):
        grown = front.join(following, ["corpus", "last"]).withColumn("next", F.col("prob") * F.col("p"))
        if base and not k:
            grown = grown.filter(has_base(F.col("token"), F.lit(base))).withColumn("next", F.col("next") / F.sum("next").over(Window.partitionBy("ctx_id")))
        if stop is not None and k:
            grown = grown.join(stop, ["ctx_id", "token"], "left_anti")
        if not (least and not k):
            grown = grown.filter(F.col("next") >= threshold)
        grown = grown.withColumn("k", F.row_number().over(best)).withColumn("on", (F.col("k") <= branching) & (F.col("next") >= threshold))
        grown = grown.filter(F.col("on") | (F.col("k") <= (least if not k else 0)))
        every = grown.select("ctx_id", "corpus", F.col("token").alias("last"), F.concat_ws(" ", F.when(F.col("length") > 0, F.col("path")), "token").alias("path"), F.col("next").alias("prob"), (F.col("length") + 1).alias("length"), F.col("path").alias("parent"), "on")
        found = every if found is None else found.unionByName(every)
        front = every.filter("on").drop("parent", "on")
    children = found.filter("on").groupBy("ctx_id", F.col("parent").alias("path")).agg(F.sum("prob").alias("below"))
    return found.join(children, ["ctx_id", "path"], "left").select("ctx_id", "path", "prob", "length", (F.col("prob") - F.coalesce("below", F.lit(0.0))).alias("exclusive_prob"))


def next_tokens(counted: DataFrame) -> DataFrame:
    """Maximum-likelihood next-token table from bigram counts: corpus, last, token, p."""
    w = Window.partitionBy("corpus", "ctx")
    return counted.filter("n = 2").select("corpus", F.col("ctx").alias("last"), F.substring_index("ngram", " ", -1).alias("token"), (F.col("c") / F.sum("c").over(w)).alias("p"))


def insertion(old, new, cursor):
    """Tokens inserted exactly at the cursor if new is old with an insertion there, else null. Array columns and an int column."""
    grown = F.size(new) - F.size(old)
    same = (F.slice(new, 1, cursor) == F.slice(old, 1, cursor)) & (F.slice(new, cursor + grown + 1, F.size(old) - cursor) == F.slice(old, cursor + 1, F.size(old) - cursor))
    return F.when((grown > 0) & (cursor <= F.size(old)) & same, F.slice(new, cursor + 1, grown))


def common_run(a, b):
    """Length of the longest common start of two array columns."""
    agree = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(agree, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(agree).cast("long"))
