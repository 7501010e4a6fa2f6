"""Rewriting of n-grams before they are counted: file names, common tokens, and patterns of rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RARE, FILE_NAME, THRESHOLD = "<rare>", "<fileName>", 6


def rare_online(continued_totals: DataFrame, vocabulary: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Tokens whose continuation total as a context is under the threshold; <s> never is. vocabulary: corpus, token."""
    own = continued_totals.filter("n = 2").select("corpus", F.col("ctx").alias("token"), "kn_total")
    joined = vocabulary.join(own, ["corpus", "token"], "left").withColumn("kn_total", F.coalesce("kn_total", F.lit(0)))
    return joined.filter((F.col("kn_total") < threshold - 1e-4) & (F.col("token") != "<s>"))


def common_tokens(token_counts: DataFrame, size: int) -> DataFrame:
    """The size most frequent tokens; ties by token."""
    return token_counts.orderBy(F.desc("c"), "token").limit(size)


def rewrite_rare(tokens: DataFrame, common: DataFrame) -> DataFrame:
    """Tokens outside a list of common ones (column token, bounded by its size) become <rare>."""
    known = F.broadcast(common.select("token").distinct().withColumn("known", F.lit(True)))
    return tokens.join(known, "token", "left").withColumn("token", F.when(F.col("known"), F.col("token")).otherwise(RARE)).drop("known")


def rewrite_file_name(tokens: DataFrame, name: str = "name") -> DataFrame:
    """A document's own name becomes <fileName>."""
    return tokens.withColumn("token", F.when(F.col("token") == F.col(name), FILE_NAME).otherwise(F.col("token")))


#: Tokens of a list that is broadcast; longer ones are joined.
BROADCAST = 1_000_000


def small(rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """rows with a broadcast hint if there are at most so many of them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def common_online(continued_totals: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Tokens that are not rare: those whose continuation total as a context reaches the threshold, and <s>."""
    own = continued_totals.filter("n = 2")
    return own.filter((F.col("kn_total") >= threshold - 1e-4) | (F.col("ctx") == "<s>")).select("corpus", F.col("ctx").alias("token"))


def flagged(tokens: DataFrame, common: DataFrame, order: int) -> DataFrame:
    """Adds r0, r1, ...: whether the token, and those before it (p1, p2, ...), are not among the common ones (corpus, token)."""
    known = small(common)
    names = ["token", *[f"p{k}" for k in range(1, order)]]
    for i, name in enumerate(names):
        tokens = tokens.join(known.select("corpus", F.col("token").alias(name), F.lit(True).alias(f"known{i}")), ["corpus", name], "left")
    return tokens.withColumns({f"r{i}": F.col(f"known{i}").isNull() for i in range(order)}).drop(*[f"known{i}" for i in range(order)])


def suffix_grams(full: DataFrame, order: int) -> DataFrame:
    """Gram rows of all suffixes of full n-grams (corpus, doc, pos, ngram, k)."""
    sizes = F.explode(F.sequence(F.lit(1), F.least("k", F.lit(order)))).alias("n")
    rows = full.select("corpus", "doc", "pos", "k", sizes, F.col("ngram").alias("full"))
    return rows.select("corpus", "doc", "pos", "n", F.expr("substring_index(full, ' ', -n)").alias("ngram"), (F.col("n") == F.least("k", F.lit(order))).alias("whole"))


def last_rare(order: int) -> Column:
    """How far before the token the nearest rare one of its context lies; -1 without one."""
    out = F.lit(-1)
    for k in range(order - 1, 0, -1):
        out = F.when(F.col(f"p{k}").isNotNull() & F.col(f"r{k}"), k).otherwise(out)
    return out


def pattern_rows(marked: DataFrame, order: int) -> DataFrame:
    """Flagged tokens with ngram, the pattern of up to order tokens, k, its size, and last_rare.

    Rare context tokens are numbered <0>, <1>, ... by first occurrence from the right. A rare last token takes the number
    that it has in the context, else <rare>."""
    cell = lambda t, r: F.struct(F.col(t).alias("t"), F.col(r).alias("r"))
    ctx = F.filter(F.array(*[cell(f"p{k}", f"r{k}") for k in range(1, order)]), lambda x: x["t"].isNotNull())
    seen = F.array_distinct(F.transform(F.filter("ctx", lambda x: x["r"]), lambda x: x["t"]))
    number = lambda t: F.concat(F.lit("<"), (F.array_position(F.col("seen"), t) - 1).cast("string"), F.lit(">"))
    context = F.reverse(F.transform("ctx", lambda x: F.when(x["r"], number(x["t"])).otherwise(x["t"])))
    last = F.when(~F.col("r0"), F.col("token")).when(F.array_contains("seen", F.col("token")), number(F.col("token"))).otherwise(RARE)
    out = marked.withColumn("ctx", ctx).withColumn("seen", seen)
    return out.select("corpus", "doc", "pos", F.array_join(F.concat(context, F.array(last)), " ").alias("ngram"), (F.size("ctx") + 1).alias("k"), last_rare(order).alias("last_rare"))


def pattern_grams(tokens: DataFrame, rare: DataFrame, order: int) -> DataFrame:
    """Patterns of full order, from a list of rare tokens (corpus, token)."""
    w = Window.partitionBy("corpus", "doc").orderBy("pos")
    listed = rare.select("corpus", "token").distinct().withColumn("r0", F.lit(True))
    marked = tokens.select("corpus", "doc", "pos", "token").join(listed, ["corpus", "token"], "left").withColumn("r0", F.coalesce("r0", F.lit(False)))
    before = {f"{out}{k}": F.lag(name, k).over(w) for out, name in (("p", "token"), ("r", "r0")) for k in range(1, order)}
    return pattern_rows(marked.withColumns(before), order).filter(F.col("k") == order).select("corpus", "doc", "pos", "ngram")
