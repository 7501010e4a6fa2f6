"""Log-linear scores with latent clusters: every candidate has a score per cluster, and its probability is their sum.

Base features count once; cluster features have a weight for each cluster, named with the suffix ",cluster=<i>". rows:
corpus, doc, pos, cand, truth, and a column per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators import candidates as K
from tokenlm.sources.shared import written

CONTEXT = ["corpus", "doc", "pos"]


def suffixed(name: str, cluster: int) -> str:
    return f"{name},cluster={cluster}"


def scores(values: dict[str, Column], weights: dict[str, float], clustered: list[str], clusters: int) -> Column:
    """An array with the score of each cluster. weights: by feature, or by suffixed feature; missing ones are 0."""

    def total(cluster: int) -> Column:
        out = F.lit(0.0)
        for name, value in values.items():
            w = weights.get(suffixed(name, cluster) if name in clustered else name, 0.0)
            if w:
                out = out + F.lit(w) * value
        return out

    return F.array(*[total(c) for c in range(clusters)])


def softmax(rows: DataFrame, score: Column) -> DataFrame:
    """Adds probs, the probability of candidate and cluster, and prob, their sum over clusters."""
    w = Window.partitionBy(*CONTEXT)
    out = rows.withColumn("s", score)
    out = out.withColumn("top", F.max(F.array_max("s")).over(w)).withColumn("e", F.transform("s", lambda x: F.exp(x - F.col("top"))))
    summed = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("all", F.sum(summed).over(w)).withColumn("probs", F.transform("e", lambda x: x / F.col("all")))
    return out.withColumn("prob", summed / F.col("all")).drop("s", "e", "top", "all")


def posterior(ranked: DataFrame) -> DataFrame:
    """Probability of each cluster given the truth, for contexts whose truth is a candidate: cluster, posterior."""
    hit = ranked.filter("cand = truth")
    return hit.select(*CONTEXT, F.posexplode(F.transform("probs", lambda x: x / F.col("prob"))).alias("cluster", "posterior"))


def gradient(ranked: DataFrame, values: dict[str, Column], clustered: list[str], clusters: int) -> DataFrame:
    """Mean over contexts of observed less expected feature values: the truth's, weighted by the clusters' posterior, less all
    candidates', weighted by their probability. One pass; the number of contexts is summed beside the features."""
    has = F.max((F.col("cand") == F.col("truth")).cast("int")).over(Window.partitionBy(*CONTEXT))
    held = ranked.withColumn("has", has).filter("has = 1")
    hit = (F.col("cand") == F.col("truth")).cast("double")
    cells = [F.struct(F.lit("").alias("feature"), hit.alias("g"))]
    for name, value in values.items():
        if name in clustered:
            for c in range(clusters):
                p = F.element_at("probs", c + 1)
                cells.append(F.struct(F.lit(suffixed(name, c)).alias("feature"), ((hit * p / F.col("prob") - p) * value).alias("g")))
        else:
            cells.append(F.struct(F.lit(name).alias("feature"), ((hit - F.col("prob")) * value).alias("g")))
    sums = held.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.feature").agg(F.sum("x.g").alias("g"))
    n = F.max(F.when(F.col("feature") == "", F.col("g"))).over(Window.partitionBy(F.lit(1)))  # a row per feature
    return sums.withColumn("n", n).filter("feature <> ''").select("feature", (F.col("g") / F.greatest("n", F.lit(1.0))).alias("gradient"))


def initial_weights(features: DataFrame, default: float = 0.0, spread: float = 0.0, seed: int = 1) -> DataFrame:
    """feature and weight: the default, plus a number within the spread that a hash of seed and name draws."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "feature")), 1, 10), 16, 10).cast("double") / float(1 << 40)
    return features.select("feature", (F.lit(default) + F.lit(spread) * (2 * u - 1)).alias("weight"))


def contributions(rows: DataFrame, values: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """What each feature adds to a candidate's score, largest first, without those that add nothing: place from 0."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value"), (F.lit(weights.get(n, 0.0)) * v).alias("part")) for n, v in values.items()])
    ordered = F.array_sort(F.filter(cells, lambda x: x["part"] != 0), lambda a, b: F.when(a["part"] > b["part"], -1).when(a["part"] < b["part"], 1).otherwise(F.when(a["feature"] < b["feature"], -1).otherwise(1)))
    return rows.select(*CONTEXT, "cand", F.posexplode(ordered).alias("place", "f")).select(*CONTEXT, "cand", "place", "f.feature", "f.value", "f.part")


def differences_of(ranked: DataFrame, values: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """differences of all contributions, in one pass over the truth and the best candidate of each context."""
    sign = (F.col("cand") == F.col("truth")).cast("int") - (F.col("rank") == 0).cast("int")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(weights.get(n, 0.0)) * v * sign).alias("part")) for n, v in values.items()])
    both = ranked.filter("cand = truth OR rank = 0").select(*CONTEXT, F.explode(cells).alias("x"))
    return both.groupBy(*CONTEXT, "x.feature").agg(F.sum("x.part").alias("difference")).filter(F.abs("difference") > 1e-12)


def differences_of_all(tokens: DataFrame, values: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """differences where the whole vocabulary are the candidates, ranked by score, then token, and no position meets it.

    values: increasing functions of c1, c2 and c3 that are 0 at 0, with weights that are not negative. So a candidate's score
    is least where it was never seen after the context, and the best of all is the best of three: of those seen after the last
    two tokens, of those after the last one by c1 and c2 alone, and of all by c1. What a position has depends on its last two
    tokens and its truth: each such triple is looked at once, and positions only look it up."""
    if min(weights.values()) < 0:
        raise ValueError("a negative weight: a candidate may be best for not being seen")
    ctx = written(K.context_rows(tokens), "contexts")
    triple = ["corpus", "p2", "p1", "truth"]
    grams = written(ctx.groupBy(*triple).agg(F.count("*").alias("c")), "grams")
    ones = grams.filter("truth IS NOT NULL").groupBy("corpus", "truth").agg(F.sum("c").alias("c1"))
    twos = grams.filter("truth IS NOT NULL AND p1 IS NOT NULL").groupBy("corpus", "p1", "truth").agg(F.sum("c").alias("c2"))
    known = F.col("p2").isNotNull() & F.col("p1").isNotNull() & F.col("truth").isNotNull()
    rows = grams.join(ones, ["corpus", "truth"], "left").join(twos, ["corpus", "p1", "truth"], "left")
    rows = rows.select(*triple, F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c2", F.lit(0)).alias("c2"), F.when(known, F.col("c")).otherwise(0).alias("c3"))
    parts = F.array(*[F.lit(weights.get(n, 0.0)) * v for n, v in values.items()]).alias("parts")

    def best(seen: DataFrame, name: str, *keys: str) -> DataFrame:
        scored = K.log_linear(seen, weights, values).select("*", parts)
        return scored.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("minus"), F.col("truth").alias("cand"), "parts")).alias(name))

    zero = F.lit(0).cast("long")
    rows = rows.join(best(rows.filter(known), "after_two", "corpus", "p2", "p1"), ["corpus", "p2", "p1"], "left")
    rows = rows.join(best(twos.join(ones, ["corpus", "truth"]).withColumn("c3", zero), "after_one", "corpus", "p1"), ["corpus", "p1"], "left")
    rows = rows.join(best(ones.withColumns({"c2": zero, "c3": zero}), "any", "corpus"), "corpus", "left")
    top = F.least("after_two", "after_one", "any")
    less = lambda i: F.coalesce(top["parts"][i], F.lit(0.0))
    hit = F.coalesce(top["cand"] == F.col("truth"), F.lit(False))
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(weights.get(n, 0.0)) * v - less(i)).alias("difference")) for i, (n, v) in enumerate(values.items())])
    found = rows.filter(~hit).select(*[F.col(c).alias(f"its_{c}") for c in triple], F.filter(cells, lambda x: F.abs(x["difference"]) > 1e-12).alias("x")).filter(F.size("x") > 0)
    found = written(found, "differences")
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in triple]
    return ctx.join(found, same).select(*CONTEXT, F.explode("x").alias("x")).select(*CONTEXT, "x.*")


def differences(parts: DataFrame, ranked: DataFrame) -> DataFrame:
    """By context and feature, what it adds to the truth's score less what it adds to the best candidate's."""
    keys = [*CONTEXT, "cand"]
    both = ranked.filter("cand = truth OR rank = 0").select(*keys, ((F.col("cand") == F.col("truth")).cast("int") - (F.col("rank") == 0).cast("int")).alias("sign"))
    return parts.join(both, keys).groupBy(*CONTEXT, "feature").agg(F.sum(F.col("part") * F.col("sign")).alias("difference")).filter(F.abs("difference") > 1e-12)
