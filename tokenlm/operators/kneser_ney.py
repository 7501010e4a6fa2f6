"""Kneser-Ney probabilities as joins, one level of context at a time.

statistics puts all that a level needs beside each n-gram: raw and continuation counts, and its context's totals from one
window over contexts; the empty context, whose rows are the whole vocabulary, is summed and broadcast (a row a corpus).
A level then joins the level below by the shorter n-gram and nothing else; discounts and vocabulary sizes are broadcast
(orders times corpora). Statistics and each level that another one needs are written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators import counts as C
from tokenlm.sources.shared import written


def statistics(counted: DataFrame) -> DataFrame:
    """corpus, n, ngram, ctx, back, c, w, kn, and of the context total, kn_total and followers; written to the shared folder."""
    return totalled(written(C.continuations(counted), "continued"))


def totalled(continued: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """statistics from continuations. of: corpus, n and ctx, the only contexts besides the empty one whose n-grams are asked for."""
    over = Window.partitionBy("corpus", "n", "ctx")
    sums = {"total": F.sum("c"), "kn_total": F.sum("kn"), "followers": F.count("*")}
    some = continued.filter("n > 1")
    if of is not None:
        some = some.join(of, ["corpus", "n", "ctx"], "left_semi")
    long = some.withColumns({k: v.over(over) for k, v in sums.items()})
    empty = continued.filter("n = 1").groupBy("corpus").agg(*[v.alias(k) for k, v in sums.items()])
    short = continued.filter("n = 1").join(F.broadcast(empty), "corpus")
    return written(long.unionByName(short), "statistics")


def sizes(stats: DataFrame) -> DataFrame:
    """Vocabulary size v of each corpus."""
    return stats.filter("n = 1").groupBy("corpus").agg(F.count("*").alias("v"))


def discount_of(d: DataFrame, order: int, n: int, fixed: float | Sequence[float] | None) -> float | None:
    """A manual discount: one for each order if there are as many, else the first."""
    if fixed is None or isinstance(fixed, (int, float)):
        return fixed
    return fixed[n - 1] if len(fixed) == order else fixed[0]


def levels(counted: DataFrame, order: int, fixed: float | Sequence[float] | None = None, use_kn: bool = True, backoff: DataFrame | None = None, stats: DataFrame | None = None) -> dict[int, DataFrame]:
    """Interpolated probability p of each seen n-gram, by n.

    p(w|s) = (max(C - D, 0) + D * followers(s) * p(w|s without its first token)) / total(s), and 1 / V without context.
    C and total are raw counts at full order, continuation counts below. A total of 0 hands down to the level below.
    fixed: manual discounts. backoff: gram counts of another corpus table, which give discounts and V in place of counted's.
    """
    stats = statistics(counted) if stats is None else stats
    other = stats if backoff is None else statistics(backoff)
    d = F.broadcast(C.discounts(C.counts_of_counts(other)))
    size = F.broadcast(sizes(other))
    out: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        raw = n == order or not use_kn
        x, total = ("c", "total") if raw else ("kn", "kn_total")
        rows = stats.filter(F.col("n") == n).select("corpus", "ngram", "back", "w", F.col(x).alias("x"), F.col(total).alias("total"), "followers")
        manual = discount_of(d, order, n, fixed)
        if manual is None:
            own = d.filter((F.col("n") == n) & (F.col("kind") == ("raw" if raw else "kn"))).select("corpus", "discount")
            rows = rows.join(own, "corpus")
        else:
            rows = rows.withColumn("discount", F.lit(float(manual)))
        if n == 1:
            rows = rows.join(size, "corpus").withColumn("lower", 1 / F.col("v"))
        else:
            rows = rows.join(out[n - 1].select("corpus", F.col("ngram").alias("back"), F.col("p").alias("lower")), ["corpus", "back"])
        one = rows.select("corpus", F.lit(n).alias("n"), "ngram", "x", "total", "followers", "discount", "lower", interpolated().alias("p"), "w")
        out[n] = written(one, f"level{n}") if 1 < n < order else one
    return out


def interpolated() -> Column:
    p = (F.greatest(F.col("x") - F.col("discount"), F.lit(0.0)) + F.col("discount") * F.col("followers") * F.col("lower")) / F.col("total")
    return F.when(F.col("total") > 0, p).otherwise(F.col("lower"))


def entropy(counted: DataFrame, order: int) -> DataFrame:
    """Mean of -ln p over all positions, by corpus: each position's whole n-gram, weighted by how often it occurs."""
    every = None
    for one in levels(counted, order).values():
        own = one.filter("w > 0").select("corpus", "w", "p")
        every = own if every is None else every.unionByName(own)
    h = F.sum(F.when(F.col("p") > 0, -F.log("p") * F.col("w"))) / F.sum(F.when(F.col("p") > 0, F.col("w")))
    return every.groupBy("corpus").agg(F.sum("w").alias("n_tokens"), h.alias("entropy"), F.exp(h).alias("perplexity"))


def explain(counted: DataFrame, order: int) -> DataFrame:
    """For each n-gram of full order: n-gram, count and total of each level, as one string from the longest down."""
    some = levels(counted, order)
    own = counted.filter(F.col("n") == order).select("corpus", F.col("ngram").alias("full"))
    part = F.col("full")
    parts = []
    for n in range(order, 0, -1):
        own = own.withColumn(f"g{n}", part)
        own = own.join(some[n].select("corpus", F.col("ngram").alias(f"g{n}"), F.concat_ws(":", F.col("x").cast("string"), F.col("total").cast("string")).alias(f"s{n}")), ["corpus", f"g{n}"], "left")
        parts.append(F.col(f"s{n}"))
        part = F.substring_index(F.col("full"), " ", -(n - 1)) if n > 1 else None
    return own.select("corpus", F.col("full").alias("ngram"), F.concat_ws(" ", *parts).alias("levels"))


def longest_seen(rows: DataFrame, known: DataFrame, order: int) -> DataFrame:
    """For each position, the longest context that another corpus table of counts knows; -1 if not even the empty one."""
    have = known.select("corpus", "n", "ctx").distinct().withColumn("seen", F.lit(True))
    joined = rows.join(have, ["corpus", "n", "ctx"], "left")
    return joined.groupBy("corpus", "doc", "pos").agg(F.coalesce(F.max(F.when(F.col("seen"), F.col("n") - 1)), F.lit(-1)).alias("context_max_n"))


def modified_discounts(counted: DataFrame) -> DataFrame:
    """Three discounts by order from n1 to n4: Y = n1 / (n1 + 2 n2), D_i = i - (i + 1) Y n_(i+1) / n_i.

    0.5 replaces a discount that is undefined or outside [0, 1]."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    base = counted.groupBy("corpus", "n").agg(*n).withColumn("y", F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))
    out = [F.col("corpus"), F.col("n")]
    for i in (1, 2, 3):
        d = F.when(F.col(f"n{i}") > 0, i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}"))
        out.append(F.when(d.between(0, 1), d).otherwise(0.5).alias(f"d{i}"))
    return base.select(*out)


def modified(counted: DataFrame, order: int) -> DataFrame:
    """Probabilities with three discounts over raw counts: (C - D(C) + pool(ctx) * lower) / total, 1 / V at the end.

    A context's pool comes from one window over contexts; the empty one is summed and broadcast."""
    held = written(counted.join(F.broadcast(modified_discounts(counted)), ["corpus", "n"]), "discounted")
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    over = Window.partitionBy("corpus", "ctx")
    empty = held.filter("n = 1").groupBy("corpus").agg(F.sum("c").alias("total"), F.sum(cut).alias("pool"), F.count("*").alias("v"))
    lower = None
    for n in range(1, order + 1):
        own = held.filter(F.col("n") == n).select("corpus", "ngram", "ctx", "back", "c", cut.alias("cut"))
        if lower is None:
            rows = own.join(F.broadcast(empty), "corpus").withColumn("lower", 1 / F.col("v"))
        else:
            rows = own.withColumns({"total": F.sum("c").over(over), "pool": F.sum("cut").over(over)}).join(lower.select("corpus", F.col("ngram").alias("back"), F.col("p").alias("lower")), ["corpus", "back"])
        lower = rows.select("corpus", F.lit(n).alias("n"), "ngram", "c", "total", ((F.col("c") - F.col("cut") + F.col("pool") * F.col("lower")) / F.col("total")).alias("p"))
    return lower
