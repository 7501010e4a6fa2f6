"""Gradients and updates of log-linear weights."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.sources.shared import written


def gradient(ranked: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean over contexts of observed less expected feature values. ranked: cand, truth, prob per candidate.

    Contexts are counted in the same pass, as one more feature."""
    hit = F.col("cand") == F.col("truth")
    coef = hit.cast("double") - F.col("prob")
    held = ranked.withColumn("has", F.max(hit.cast("int")).over(_context())).filter("has = 1")
    cells = [F.struct(F.lit(n).alias("feature"), (coef * v).alias("g")) for n, v in values.items()] + [F.struct(F.lit("").alias("feature"), hit.cast("double").alias("g"))]
    sums = held.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.feature").agg(F.sum("x.g").alias("g"))
    n = F.max(F.when(F.col("feature") == "", F.col("g"))).over(Window.partitionBy(F.lit(1)))  # a row per feature
    return sums.withColumn("n", n).filter("feature <> ''").select("feature", (F.col("g") / F.greatest("n", F.lit(1.0))).alias("gradient"))


def _context():
    return Window.partitionBy("corpus", "doc", "pos")


def adagrad(params: DataFrame, grad: DataFrame, rate: float = 1.0, power: float = 0.5) -> DataFrame:
    """params: feature, weight, sum_sq. Gradients under 1e-6 in size change nothing."""
    g = F.coalesce("gradient", F.lit(0.0))
    g = F.when(F.abs(g) < 1e-6, 0.0).otherwise(g)
    sq = F.col("sum_sq") + g * g
    return params.join(grad, "feature", "left").select("feature", (F.col("weight") + F.when(g != 0, rate * g / F.pow(sq, F.lit(power))).otherwise(0.0)).alias("weight"), sq.alias("sum_sq"))


def dual_averaging(params: DataFrame, grad: DataFrame, step: float) -> DataFrame:
    """params: feature, sum_grad. The weight is the step times the sum of gradients."""
    s = F.col("sum_grad") + F.coalesce("gradient", F.lit(0.0))
    return params.join(grad, "feature", "left").select("feature", (step * s).alias("weight"), s.alias("sum_grad"))


#: Contexts of one chunk of a sequential pass.
CHUNK = 1 << 16


def sequential(rows: DataFrame, features: list[str], rate: float = 1.0, batch: int = 1, method: str = "adagrad", power: float = 0.5, decay: float = 0.0, order_by: str = "g", chunk: int = CHUNK) -> DataFrame:
    """Weights of each corpus after one pass over all its contexts in order.

    rows: corpus, order_by (a number from 0 up), cand, truth, and one column per feature. Each update uses the last weights, so only
    corpora run in parallel. A corpus is read in chunks of as many places as chunk says, and each chunk starts from
    the weights, sums and waiting gradients that the one before it ended with: no task holds more than one chunk of a corpus.
    """
    spark = rows.sparkSession
    cut = rows.select("corpus", order_by, "cand", (F.col("cand") == F.col("truth")).alias("hit"), *features, F.floor(F.col(order_by) / chunk).alias("chunk"))
    held = written(cut.repartitionByRange("chunk", "corpus"), "contexts")
    ends: dict[str | None, bytes] = {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corpus, n = pdf.corpus.iloc[0], len(features)
        w, sq, total, t, waiting = pickle.loads(ends[corpus]) if corpus in ends else (np.zeros(n), np.zeros(n), np.zeros(n), 0, [])
        pdf = pdf.sort_values([order_by, "cand"])
        values, hits, places = pdf[features].to_numpy(float), pdf.hit.fillna(False).to_numpy(bool), pdf[order_by].to_numpy()
        starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        for a, b in zip(starts, [*starts[1:], len(places)]):
            hit = hits[a:b]
            if not hit.any():
                continue
            x = values[a:b]
            s = x @ w
            p = np.exp(s - s.max())
            waiting.append(x[hit].sum(0) - (p / p.sum()) @ x)
            if len(waiting) < batch:
                continue
            g, waiting, t = np.mean(waiting, 0), [], t + 1
            g[np.abs(g) < 1e-6] = 0
            sq, total = sq + g * g, total + g
            step = rate / t**decay
            if method == "dual":
                w = step * total
            elif method == "adagrad":
                w = w + np.where(sq > 0, rate * g / np.where(sq > 0, sq, 1) ** power, 0)
            else:
                w = w + step * g
        return pd.DataFrame({"corpus": [corpus], "state": [pickle.dumps((w, sq, total, t, waiting))]})

    for k in sorted(r[0] for r in held.select("chunk").distinct().collect()):
        part = held.filter(F.col("chunk") == k).groupBy("corpus").applyInPandas(run, "corpus string, state binary")
        ends |= {r.corpus: bytes(r.state) for r in part.collect()}
    found = [(corpus, f, float(v)) for corpus, state in ends.items() for f, v in zip(features, pickle.loads(state)[0])]
    return spark.createDataFrame(found, "corpus string, feature string, weight double")


def perceptron(rows: DataFrame, order_by: str = "g") -> DataFrame:
    """Weights of a mixing perceptron after one pass: ln p of the truth less that of the best other value, times 1 / sqrt(t).

    rows: corpus, order_by, feature, lp_truth, lp_top."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.feature.unique())
        w = dict.fromkeys(names, 1.0)
        for t, (_, one) in enumerate(pdf.sort_values(order_by).groupby(order_by), 1):
            for f, a, b in zip(one.feature, one.lp_truth, one.lp_top):
                w[f] += (a - b) / t**0.5
        return pd.DataFrame({"corpus": pdf.corpus.iloc[0], "feature": names, "weight": [w[n] for n in names]})

    return rows.groupBy("corpus").applyInPandas(run, "corpus string, feature string, weight double")
