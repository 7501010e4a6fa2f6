"""N-gram statistics over token tables (corpus, doc, pos, token).

grams gives every n-gram that ends at a position; the statistics are plain group-bys over it. N-grams are token
strings joined by a space, and context and shorter forms are cut from them where they are needed, so that only one string
a row is shuffled. An n-gram is whole if it reaches back to the document's start or has the full order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators.ordering import running_sums


def grams(tokens: DataFrame, order: int, least: int = 1) -> DataFrame:
    """corpus, doc, pos, n (least to order), ngram, ctx (all but the last token), back (all but the first) and whole.

    Tokens may bring the columns p1, p2, ... of the tokens before them, as lex gives them; otherwise a window finds them."""
    names = [f"p{k}" for k in range(1, order)]
    if set(names) <= set(tokens.columns):
        wide = tokens.select("corpus", "doc", "pos", "token", *names, F.col("pos").alias("k"))
    else:
        w = Window.partitionBy("corpus", "doc").orderBy("pos")
        wide = tokens.select("corpus", "doc", "pos", "token", *[F.lag("token", k).over(w).alias(p) for k, p in enumerate(names, 1)], F.row_number().over(w).alias("k"))
    rows = []
    for n in range(least, order + 1):
        parts = [*names[n - 2 :: -1], "token"] if n > 1 else ["token"]
        rows.append(F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *parts).alias("ngram"), (F.col("k") == n if n < order else F.col("k") >= n).alias("whole")))
    cells = wide.select("corpus", "doc", "pos", "k", F.explode(F.array(*rows)).alias("g")).filter("g.n <= k")
    return cut(cells.select("corpus", "doc", "pos", "g.*")).select("corpus", "doc", "pos", "n", "ngram", "ctx", "back", "whole")


def cut(rows: DataFrame) -> DataFrame:
    """Adds ctx and back to n and ngram."""
    return rows.withColumns({"ctx": F.expr("substring_index(ngram, ' ', n - 1)"), "back": F.expr("substring_index(ngram, ' ', 1 - n)")})


def ngram_counts(rows: DataFrame) -> DataFrame:
    """c: how often an n-gram occurs; w: how often as a whole one."""
    return cut(rows.groupBy("corpus", "n", "ngram").agg(F.count("*").alias("c"), F.sum(F.col("whole").cast("long")).alias("w"))).select("corpus", "n", "ngram", "ctx", "back", "c", "w")


def contexts(counted: DataFrame) -> DataFrame:
    """total and distinct followers of each context."""
    return counted.groupBy("corpus", "n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("followers"))


def continuations(counted: DataFrame) -> DataFrame:
    """kn: distinct predecessors of an n-gram, plus its occurrences as a whole one. Other columns stay.

    Each n-gram adds one to its shorter form: one group-by of both kinds of rows by n-gram, without a join."""
    none = F.lit(0).cast("long")
    own = F.struct(F.col("n"), F.col("ngram"), F.col("c"), F.col("w"), none.alias("kd"))
    up = F.struct((F.col("n") - 1).alias("n"), F.col("back").alias("ngram"), none.alias("c"), none.alias("w"), F.lit(1).cast("long").alias("kd"))
    both = counted.select("corpus", F.explode(F.array(own, up)).alias("x")).select("corpus", "x.*").filter("n > 0")
    summed = both.groupBy("corpus", "n", "ngram").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("kd").alias("kd")).filter("c <> 0")
    return cut(summed).select("corpus", "n", "ngram", "ctx", "back", "c", "w", (F.col("kd") + F.col("w")).alias("kn"))


def continuation_totals(continued: DataFrame) -> DataFrame:
    return continued.groupBy("corpus", "n", "ctx").agg(F.sum("kn").alias("kn_total"))


def counts_of_counts(continued: DataFrame) -> DataFrame:
    """n1 and n2 by order, of raw counts and of continuation counts."""
    ones = [F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in ("c", "kn") for k in (1, 2)]
    both = continued.groupBy("corpus", "n").agg(*ones)
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{c}1").alias("n1"), F.col(f"{c}2").alias("n2")) for kind, c in (("raw", "c"), ("kn", "kn"))])).alias("x")
    return both.select("corpus", "n", kinds).select("corpus", "x.kind", "n", "x.n1", "x.n2")


def discounts(coc: DataFrame) -> DataFrame:
    """n1 / (n1 + 2 n2) by order; 0 where either is 0."""
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    return coc.select("corpus", "kind", "n", d.alias("discount"))


def followers(rows: DataFrame, longest: int = 2) -> DataFrame:
    """Distinct next tokens of contexts of up to longest tokens."""
    return rows.filter(F.col("n") <= longest + 1).select("corpus", "n", "ctx", F.substring_index("ngram", " ", -1).alias("token")).distinct()


def documents_per_token(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("corpus", "token").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("c"))


def cumulative_dump(counted: DataFrame, least: float = 2.9999) -> DataFrame:
    """Values in falling order with their running sum, ties by n-gram; small values aren't listed (and come last in the sum)."""
    rows = counted.filter(F.col("c") > least).select("corpus", "ngram", "c")
    return running_sums(rows, ["corpus"], [-F.col("c"), "ngram"], "c", "cumulative").select("corpus", "ngram", "c", "cumulative")
