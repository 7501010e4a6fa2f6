"""Combining the predictions of several context features.

rows has one line per position and feature: key columns, feature, count (of the value in the context) and total (of the context).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.functions.scalars import UNSEEN, log10_bucket, max_likelihood


def feature_counts(contexts: DataFrame, features: list[str]) -> DataFrame:
    """count of each (feature, context value, token) and total of each context. contexts: one column per feature, and token."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    long = contexts.select("token", cells.alias("x")).select("x.feature", "x.value", "token")
    counted = long.groupBy("feature", "value", "token").agg(F.count("*").alias("count"))
    totals = counted.groupBy("feature", "value").agg(F.sum("count").alias("total"))
    return counted.join(totals, ["feature", "value"])


def product_of_experts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.log(max_likelihood(F.col("count"), F.col("total")))).alias("score"))


def weighted_product(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """weights: feature, bucket (the context total's power of ten), weight."""
    p = F.log(max_likelihood(F.col("count"), F.col("total")))
    return rows.withColumn("bucket", log10_bucket(F.col("total"))).join(weights, ["feature", "bucket"]).groupBy(*keys).agg(F.sum(F.col("weight") * p).alias("score"))


def naive_bayes(counted: DataFrame, tokens_total: DataFrame) -> DataFrame:
    """ln of smoothed prior times likelihoods of each token's own contexts, by feature. tokens_total: token, n; counted: feature_counts."""
    all_n = tokens_total.agg(F.sum("n").alias("all_n"), F.count("*").alias("v"))
    rows = counted.join(tokens_total, "token").join(F.broadcast(all_n))
    prior = F.log((F.col("n") + 1) / (F.col("all_n") + F.col("v")))
    like = F.log((F.col("count") + UNSEEN) / (F.col("n") + 1))
    return rows.select("feature", "value", "token", (prior + like).alias("score"))


def multiplicative_weights(rows: DataFrame, position: str) -> DataFrame:
    """Weights before each position if each feature's weight is multiplied by its probability and all are renormalised.

    In closed form: the softmax over features of running sums of ln p."""
    p = F.log(max_likelihood(F.col("count"), F.col("total")))
    past = Window.partitionBy("doc", "feature").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    logs = rows.withColumn("s", F.coalesce(F.sum(p).over(past), F.lit(0.0)))
    at = Window.partitionBy("doc", position)
    e = F.exp(F.col("s") - F.max("s").over(at))
    return logs.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(at)).drop("s", "e")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series for (n + 7)!, less the logarithms of the seven factors too many; right to some 1e-10."""
    z = n + 8.0
    product = F.lit(1.0)
    for k in range(1, 8):
        product = product * (n + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def model_average(counted: DataFrame) -> DataFrame:
    """Weight of each feature by its marginal likelihood under a uniform Dirichlet prior over the vocabulary.

    ln m = sum over contexts of ln (v - 1)! - ln (total + v - 1)! + sum of ln count!; weights are their softmax."""
    v = counted.select("token").distinct().agg(F.count("*").alias("v"))
    by_context = counted.withColumn("f", log_factorial(F.col("count").cast("double"))).groupBy("feature", "value").agg(F.sum("f").alias("f"), F.first("total").alias("total"))
    terms = by_context.join(F.broadcast(v)).withColumn("t", F.col("f") + log_factorial(F.col("v") - 1.0) - log_factorial(F.col("total") + F.col("v") - 1.0))
    marginal = terms.groupBy("feature").agg(F.sum("t").alias("log_marginal"))
    every = Window.partitionBy(F.lit(1))  # one row per feature
    e = F.exp(F.col("log_marginal") - F.max("log_marginal").over(every))
    return marginal.withColumn("e", e).select("feature", "log_marginal", (F.col("e") / F.sum("e").over(every)).alias("weight"))


def lattice_counts(contexts: DataFrame, chains: list[list[str]]) -> DataFrame:
    """Counts at every node of the cross product of chains. A chain is a list of columns from specific to general; '' ends it."""
    nodes = [[]]
    for chain in chains:
        nodes = [n + [c] for n in nodes for c in [*chain, ""]]
    cell = lambda n: F.concat_ws("|", *[F.col(c) if c else F.lit("") for c in n])
    exploded = F.explode(F.array(*[F.struct(F.lit("/".join(c or "*" for c in n)).alias("node"), cell(n).alias("value")) for n in nodes]))
    long = contexts.select("token", exploded.alias("x")).select("x.node", "x.value", "token")
    return long.groupBy("node", "value", "token").agg(F.count("*").alias("count"))


def lattice_probability(counted: DataFrame, contexts: DataFrame, chains: list[list[str]], discount: float = 0.5) -> DataFrame:
    """p of each position's token: the most specific nodes' counts, backed off to the mean over one-step generalisations.

    Backoff is the sum of numerators over the sum of denominators of the generalisations; 1 / v at the top."""
    stats = counted.groupBy("node", "value").agg(F.sum("count").alias("total"), F.count("*").alias("followers"))
    size = counted.select("token").distinct().count()
    nodes = [[]]
    for chain in chains:
        nodes = [n + [i] for n in nodes for i in range(len(chain) + 1)]
    nodes.sort(key=lambda n: -sum(n))
    name = lambda n: "/".join((chains[k] + ["*"])[i] for k, i in enumerate(n))
    value = lambda n: F.concat_ws("|", *[F.col(chains[k][i]) if i < len(chains[k]) else F.lit("") for k, i in enumerate(n)])
    rows = contexts
    for j, n in enumerate(nodes):
        own = counted.filter(F.col("node") == name(n)).select(F.col("value").alias("v"), F.col("token"), F.col("count").alias(f"c{j}"))
        of = stats.filter(F.col("node") == name(n)).select(F.col("value").alias("v"), F.col("total").alias(f"t{j}"), F.col("followers").alias(f"f{j}"))
        rows = rows.withColumn("v", value(n)).join(own, ["v", "token"], "left").join(of, ["v"], "left").drop("v")
        up = [k for k, m in enumerate(nodes[:j]) if sum(m) == sum(n) + 1 and all(b - a in (0, 1) for a, b in zip(n, m))]
        c, t, f = (F.coalesce(F.col(f"{x}{j}"), F.lit(0)) for x in "ctf")
        lower = F.lit(1.0 / max(size, 1)) if not up else sum((F.col(f"num{k}") for k in up), F.lit(0.0)) / sum((F.col(f"den{k}") for k in up), F.lit(0.0))
        rows = rows.withColumns({f"num{j}": F.greatest(c - discount, F.lit(0.0)) + discount * f * lower, f"den{j}": t.cast("double")})
    last = len(nodes) - 1
    return rows.withColumn("p", F.col(f"num{last}") / F.col(f"den{last}")).drop(*[f"{x}{j}" for x in ("c", "t", "f", "num", "den") for j in range(last + 1)])
