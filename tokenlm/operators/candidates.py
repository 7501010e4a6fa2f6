"""Candidates for the next token of contexts, and their scores.

A context is (corpus, doc, pos) with its true token. Candidates come in stages: tokens seen after the last two tokens
(stage 0) or the last one (1), earlier tokens of the same document (2), the whole vocabulary (3); the first stage
that produces a token wins. Stage 3 pairs contexts with a vocabulary whose size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.functions import scalars as S

VOCABULARY_LIMIT = 10_000


def context_rows(tokens: DataFrame) -> DataFrame:
    """Positions with their token as truth, and the two tokens before it, brought along (as lex does) or found by a window."""
    if {"p1", "p2"} <= set(tokens.columns):
        return tokens.select("corpus", "doc", "pos", F.col("token").alias("truth"), "p1", "p2")
    w = Window.partitionBy("corpus", "doc").orderBy("pos")
    return tokens.select("corpus", "doc", "pos", F.col("token").alias("truth"), F.lag("token", 1).over(w).alias("p1"), F.lag("token", 2).over(w).alias("p2"))


def staged(tokens: DataFrame, known: DataFrame, with_vocabulary: bool = True) -> DataFrame:
    """corpus, doc, pos, truth, cand, stage. known: followers (corpus, n, ctx, token)."""
    ctx = context_rows(tokens)
    keys = ["corpus", "doc", "pos", "truth"]
    f = known.withColumnRenamed("token", "cand")
    two = ctx.filter("p2 IS NOT NULL").withColumn("ctx", F.concat_ws(" ", "p2", "p1")).join(f.filter("n = 3").select("corpus", "ctx", "cand"), ["corpus", "ctx"]).select(*keys, "cand", F.lit(0).alias("stage"))
    one = ctx.filter("p1 IS NOT NULL").join(f.filter("n = 2").select("corpus", F.col("ctx").alias("p1"), "cand"), ["corpus", "p1"]).select(*keys, "cand", F.lit(1).alias("stage"))
    first = tokens.groupBy("corpus", "doc", F.col("token").alias("cand")).agg(F.min("pos").alias("at"))
    inside = ctx.join(first, ["corpus", "doc"]).filter("at < pos").select(*keys, "cand", F.lit(2).alias("stage"))
    every = two.union(one).union(inside)
    if with_vocabulary:
        words = tokens.select("corpus", F.col("token").alias("cand")).distinct()
        if words.groupBy("corpus").count().filter(F.col("count") > VOCABULARY_LIMIT).limit(1).count():
            raise ValueError(f"a vocabulary has over {VOCABULARY_LIMIT} tokens; leave out the last stage")
        every = every.union(ctx.join(words, "corpus").select(*keys, "cand", F.lit(3).alias("stage")))
    return every.groupBy(*keys, "cand").agg(F.min("stage").alias("stage"))


def top_followers(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent next tokens of each context of one or two tokens, up to most of them; ties by token."""
    rows = counted.filter("n IN (2, 3)").select("corpus", "n", "ctx", F.substring_index("ngram", " ", -1).alias("token"), "c")
    place = F.row_number().over(Window.partitionBy("corpus", "n", "ctx").orderBy(F.desc("c"), "token"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("corpus", "n", "ctx", "token")


def beam(tokens: DataFrame, known: DataFrame, most: int, look_back: int = 30) -> DataFrame:
    """Candidates of tokens (with p1 to p<look_back>): those seen after the last two or the last token, then the last look_back
    tokens; of all, the first most by stage, then token.

    No stage pairs a position with a whole vocabulary or document, so rows are bounded by positions times 2 * most + look_back.
    """
    keys = ["corpus", "doc", "pos", "truth"]
    ctx = context_rows(tokens)
    f = known.withColumnRenamed("token", "cand")
    two = ctx.filter("p2 IS NOT NULL").withColumn("ctx", F.concat_ws(" ", "p2", "p1")).join(f.filter("n = 3").drop("n"), ["corpus", "ctx"]).select(*keys, "cand", F.lit(0).alias("stage"))
    one = ctx.filter("p1 IS NOT NULL").join(f.filter("n = 2").select("corpus", F.col("ctx").alias("p1"), "cand"), ["corpus", "p1"]).select(*keys, "cand", F.lit(1).alias("stage"))
    near = F.explode(F.array_compact(F.array(*[f"p{k}" for k in range(1, look_back + 1)])))
    recent = tokens.select("corpus", "doc", "pos", F.col("token").alias("truth"), near.alias("cand"), F.lit(2).alias("stage"))
    every = two.union(one).union(recent).groupBy(*keys, "cand").agg(F.min("stage").alias("stage"))
    return capped(every, most)


def by_prefix(typed: DataFrame, counts: DataFrame, size: int, most: int) -> DataFrame:
    """The most frequent words that start with what was typed (doc, base of size characters), up to most of each, smart-case.

    Words meet bases by their first characters in small letters, an equi-join; the case is looked at afterwards."""
    key = F.lower(F.substring("token", 1, size))
    rows = typed.withColumn("key", F.lower("base")).join(counts.withColumn("key", key), "key").filter(S.has_base(F.col("token"), F.col("base"), True))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("c"), "token"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("key", "place")


def injected(ranked: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts whose truth is not among their candidates, with the truth as a candidate of its own; it has no probability."""
    hit = ranked.filter("cand = truth").select("corpus", "doc", "pos")
    return contexts.join(hit, ["corpus", "doc", "pos"], "left_anti").select("corpus", "doc", "pos", "truth", F.col("truth").alias("cand"))


def capped(candidates: DataFrame, most: int) -> DataFrame:
    """The first most candidates of each context by stage, then token."""
    w = Window.partitionBy("corpus", "doc", "pos").orderBy("stage", "cand")
    return candidates.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def scored(candidates: DataFrame, tokens: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds c1, c2, c3: counts of the candidate after 0, 1 and 2 tokens of context; 0 where unseen."""
    ctx = context_rows(tokens).drop("truth")
    out = candidates.join(ctx, ["corpus", "doc", "pos"])
    for n, parts in ((1, ["cand"]), (2, ["p1", "cand"]), (3, ["p2", "p1", "cand"])):
        own = counted.filter(F.col("n") == n).select("corpus", F.col("ngram").alias("g"), F.col("c").alias(f"c{n}"))
        full = F.when(F.col(parts[0]).isNotNull(), F.concat_ws(" ", *parts))
        out = out.withColumn("g", full).join(own, ["corpus", "g"], "left").drop("g").withColumn(f"c{n}", F.coalesce(f"c{n}", F.lit(0)).cast("long"))
    return out.drop("p1", "p2")


def log_linear(rows: DataFrame, weights: dict[str, float], values: dict[str, Column]) -> DataFrame:
    """score: the sum of weight times value over features."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * values[name]
    return rows.withColumn("score", total)


def softmax(rows: DataFrame) -> DataFrame:
    """prob of each candidate of a context from its score, and its rank from 0; ties by token."""
    w = Window.partitionBy("corpus", "doc", "pos")
    e = F.exp(F.col("score") - F.max("score").over(w))
    out = rows.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w)).drop("e")
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "cand")) - 1)


def inferred(ranked: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per context: oracle (truth among the candidates), correct, rank, entropy and reciprocal rank of the truth."""
    hit = ranked.filter("cand = truth").select("corpus", "doc", "pos", "prob", "rank")
    out = contexts.join(hit, ["corpus", "doc", "pos"], "left")
    return out.select("corpus", "doc", "pos", "truth", F.col("prob").isNotNull().alias("oracle"), F.coalesce(F.col("rank") == 0, F.lit(False)).alias("correct"), "rank", (-F.log("prob")).alias("entropy"), F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def identifier_metrics(states: DataFrame, by: list[str]) -> DataFrame:
    """Means over identifiers alone: accuracy, oracle, entropy and, of those on the beam, reciprocal rank."""
    ident = states.filter(F.col("truth").rlike(r"^\w+$"))
    return ident.groupBy(*by).agg(F.count("*").alias("n_identifiers"), F.avg(F.col("correct").cast("double")).alias("ident_accuracy"), F.avg(F.col("oracle").cast("double")).alias("ident_oracle"), F.avg("entropy").alias("ident_entropy"), F.avg(F.when(F.col("oracle"), F.col("reciprocal_rank"))).alias("ident_reciprocal_rank"))


def metrics(states: DataFrame, by: list[str]) -> DataFrame:
    ident = F.col("truth").rlike(r"^\w+$")
    mean = lambda c: F.avg(c)
    return states.groupBy(*by).agg(
        F.count("*").alias("n_tokens"), mean(F.col("correct").cast("double")).alias("accuracy"), mean(F.col("oracle").cast("double")).alias("oracle"), mean("rank").alias("rank"), mean("reciprocal_rank").alias("reciprocal_rank"), mean("entropy").alias("entropy"),
        mean(F.when(ident, F.col("correct").cast("double"))).alias("ident_accuracy"), mean(F.when(ident, F.col("entropy"))).alias("ident_entropy"), F.exp(mean("entropy")).alias("perplexity"),
    )


def typed_prefixes(ranked: DataFrame, longest: int = 3) -> DataFrame:
    """Ranks among the candidates that start with the truth's first characters, for 0 to longest of them."""
    sizes = F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("prefix")
    rows = ranked.select("*", sizes).filter(F.lower("cand").startswith(F.lower(F.expr("substring(truth, 1, prefix)"))))
    w = Window.partitionBy("corpus", "doc", "pos", "prefix").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w) - 1)


def keystrokes(hits: DataFrame, n: int = 5) -> DataFrame:
    """Keys typed with completion lists of n entries, and saved, by prefix. hits: truth, prefix, place (null: not found)."""
    size = F.length("truth")
    used = F.when(F.col("place") < n, F.least(size, F.col("prefix") + 1 + F.least(F.col("place"), n + 1 - F.col("place")))).otherwise(size)
    return hits.groupBy("prefix").agg(F.sum(used).alias("actual"), F.sum(size).alias("most"), (F.sum(size - used) / F.count("*")).alias("saved_per_token"))


def unreached(states: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How many truths are on the beam, in the vocabulary but off the beam, or in no vocabulary (oov)."""
    words = vocabulary.select("corpus", F.col("token").alias("truth")).distinct().withColumn("known", F.lit(True))
    label = F.when(F.col("oracle"), "onBeam").when(F.col("known"), "offBeam").otherwise("oov")
    return states.join(words, ["corpus", "truth"], "left").groupBy("corpus", label.alias("state")).agg(F.count("*").alias("n"))
