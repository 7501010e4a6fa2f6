"""Features of n-grams from Kneser-Ney statistics, whether or not the n-gram, or its context, has been seen.

looked_up puts the counts of every suffix of an n-gram beside it, two joins a level; all features are expressions over
them. rows: corpus, ngram (up to order tokens) and whatever else; k, the n-gram's number of tokens, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlm.operators import counts as C
from tokenlm.operators import kneser_ney

FIELDS = ("c", "kn", "total", "kn_total", "followers", "discount")


def contexts(rows: DataFrame, order: int) -> DataFrame:
    """corpus, n and ctx of all suffixes of n-grams with a context."""
    cells = [F.when(F.size(F.split("ngram", " ")) >= n, F.struct(F.lit(n).alias("n"), F.substring_index(F.substring_index("ngram", " ", -n), " ", n - 1).alias("ctx"))) for n in range(2, order + 1)]
    return rows.select("corpus", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("corpus", "x.*").distinct()


def looked_up(rows: DataFrame, stats: DataFrame, order: int, every: DataFrame | None = None) -> DataFrame:
    """Adds k, v (the vocabulary's size) and l1, l2, ...: c, kn, total, kn_total, followers and discount of each suffix; 0 if unseen.

    every: all continuations, for the discounts, where stats holds only the n-grams of the rows' contexts."""
    d = C.discounts(C.counts_of_counts(stats if every is None else every))
    raw = lambda n: "raw" if n == order else "kn"
    constants = d.groupBy("corpus").agg(*[F.max(F.when((F.col("n") == n) & (F.col("kind") == raw(n)), F.col("discount"))).alias(f"d{n}") for n in range(1, order + 1)])
    out = rows.withColumn("k", F.size(F.split("ngram", " "))).join(F.broadcast(constants.join(kneser_ney.sizes(stats), "corpus")), "corpus")
    for n in range(1, order + 1):
        own = stats.filter(F.col("n") == n)
        seen = own.select("corpus", F.col("ngram").alias("g"), "c", "kn")
        of = own.groupBy("corpus", F.col("ctx").alias("h")).agg(*[F.first(x).alias(x) for x in FIELDS[2:5]])
        part = F.when(F.col("k") >= n, F.substring_index("ngram", " ", -n))
        out = out.withColumn("g", part).withColumn("h", F.substring_index("g", " ", n - 1)).join(seen, ["corpus", "g"], "left")
        out = out.join(F.broadcast(of) if n == 1 else of, ["corpus", "h"], "left")  # one empty context a corpus
        cell = F.struct(*[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in FIELDS[:5]], F.coalesce(f"d{n}", F.lit(0.0)).alias("discount"))
        out = out.withColumn(f"l{n}", cell).drop("g", "h", f"d{n}", *FIELDS[:5])
    return out


def counts_at(n: int, order: int) -> tuple[Column, Column]:
    """Count and total of level n: raw ones at full order, continuation counts below."""
    s = F.col(f"l{n}")
    return (s["c"], s["total"]) if n == order else (s["kn"], s["kn_total"])


def probability(order: int) -> Column:
    """Interpolated probability of the last token."""
    p = 1 / F.col("v")
    for n in range(1, order + 1):
        s, (x, total) = F.col(f"l{n}"), counts_at(n, order)
        level = (F.greatest(x - s["discount"], F.lit(0.0)) + s["discount"] * s["followers"] * p) / total
        p = F.when((F.col("k") >= n) & (total > 0), level).otherwise(p)
    return p


Feature = tuple[Column, Column, Column]  # whether it is there, name, value


def _indicated(name: str, count: Column, there: Column) -> Feature:
    few = count <= 2
    return there, F.when(few, F.concat(F.lit(f"{name}="), count.cast("int").cast("string"))).otherwise(f"{name}.log"), F.when(few, 1.0).otherwise(F.log(count))


def count_features(order: int) -> list[Feature]:
    """Counts of all suffixes, and continuation counts of all but the n-gram itself."""
    out = []
    for n in range(order, 0, -1):
        s = F.col(f"l{n}")
        out += [_indicated(f"count{n}", s["c"], F.col("k") >= n), _indicated(f"diversityCount{n}", s["kn"], F.col("k") > n)]
    return out


def seen_features(order: int) -> list[Feature]:
    """Counts from the n-gram down to its first suffix that has been seen: an indicator and a logarithm each."""
    out, live = [], F.lit(True)
    for n in range(order, 0, -1):
        s, there = F.col(f"l{n}"), (F.col("k") >= n) & live
        parts = [("count", s["c"], there), ("knCount", s["kn"], there)]
        if n < order:
            parts.insert(1, ("distinctCount", F.col(f"l{n + 1}")["followers"], there & (F.col("k") > n)))
        for name, x, ok in parts:
            out.append((ok, F.when(x <= 2, F.concat(F.lit(f"{name}{n}="), x.cast("int").cast("string"))).otherwise(f"{name}{n}>=3"), F.lit(1.0)))
            out.append((ok, F.lit(f"{name}{n}.log"), F.log(x + 1)))
        live = live & ((F.col("k") < n) | (s["c"] == 0))
    return out


def _named(name: str, start: Column) -> Column:
    return F.concat(F.lit(f"{name},start="), start.cast("string"))


def interpolation_parts(order: int, discounts: int = 1) -> list[Feature]:
    """The terms of which interpolated probabilities are sums: shares and discounts of each level, times the weight that the
    levels above leave. start is the first level whose context has been seen."""
    out, factor, start = [], F.lit(1.0), F.col("k")
    for n in range(order, 0, -1):
        x, total = counts_at(n, order)
        s, there = F.col(f"l{n}"), F.col("k") >= n
        seen = there & (total > 0)
        out.append((seen, _named(f"prob{n}", start), factor * x / total))
        out.append((seen & (x >= discounts), _named(f"discount{n}>={float(discounts)}", start), factor / total))
        out += [(seen & (x == i), _named(f"discount{n}={i}", start), factor / total) for i in range(1, discounts)]
        factor, start = F.when(seen, factor * s["followers"] / total).otherwise(factor), F.when(there & ~(total > 0), start - 1).otherwise(start)
    return out


def backoff_parts(order: int) -> list[Feature]:
    """The terms of which backed-off log probabilities are sums, down to the first suffix that has been seen."""
    out, live, start = [], F.lit(True), F.col("k")
    for n in range(order, 0, -1):
        x, total = counts_at(n, order)
        s, there = F.col(f"l{n}"), (F.col("k") >= n) & live
        seen, hit = there & (total > 0), there & (total > 0) & (x > 0)
        miss = seen & ~(x > 0)
        out += [(hit, _named(f"indicator{n}", start), F.lit(1.0)), (hit, _named(f"count{n}", start), F.log(x - s["discount"])), (hit, _named(f"total{n}", start), F.log(total))]
        out += [(miss, _named(f"distinct{n}", start), F.log(s["followers"])), (miss, _named(f"distinctTotal{n}", start), F.log(total))]
        live, start = live & ~hit, F.when(there & ~(total > 0), start - 1).otherwise(start)
    return out


def long(rows: DataFrame, keys: list[str], features: list[Feature]) -> DataFrame:
    """One row per feature that is there: keys, fname, fval."""
    cells = F.array(*[F.when(there, F.struct(name.alias("fname"), value.cast("double").alias("fval"))) for there, name, value in features])
    return rows.select(*keys, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("f")).select(*keys, "f.fname", "f.fval")
