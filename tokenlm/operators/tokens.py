"""Tokens of texts without state: a pattern, positions and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: tokens in the order in which they are tried.
PATTERN = r'[0-9]+(?:\.[0-9]+)?|\w+|!=|\+\+|--|&&|\|\||===|==|//|<=|>=|\+=|-=|/\*|\*/|"""|[^\s\w]'


def lex(docs: DataFrame, text: str = "text", before: int = 0) -> DataFrame:
    """One row per token; pos counts from 1 within a row. Other columns but the text stay.

    before: adds p1, p2, ..., the tokens so many places earlier (null near the start), which takes no window or shuffle."""
    others = [c for c in docs.columns if c != text]
    found = docs.select(*others, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)).alias("t"))
    if not before:
        return found.select(*others, F.posexplode("t").alias("at", "token")).select(*others, (F.col("at") + 1).cast("long").alias("pos"), "token")
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.col("t")).alias(f"p{k}") for k in range(1, before + 1)]
    rows = found.select(*others, "t", *shifted).select(*others, F.posexplode(F.arrays_zip("t", *[f"p{k}" for k in range(1, before + 1)])).alias("at", "z")).filter("z.t IS NOT NULL")
    return rows.select(*others, (F.col("at") + 1).cast("long").alias("pos"), F.col("z.t").alias("token"), *[F.col(f"z.p{k}").alias(f"p{k}") for k in range(1, before + 1)])


def offsets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tokens with loc, the character where each starts: blanks are matched too and dropped after the running sum."""
    parts = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PATTERN + r"|\s"), F.lit(0))).alias("at", "token"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("loc", F.coalesce(F.sum(F.length("token")).over(w), F.lit(0)).cast("long")).filter(~F.col("token").rlike(r"^\s$"))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines with their numbers from 0 and the character where each starts."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def map_unknown(tokens: DataFrame, vocabulary: DataFrame, size_limit: int = 1_000_000) -> DataFrame:
    """Tokens outside a fixed vocabulary (column token) become <oov>. A vocabulary of up to size_limit words is broadcast."""
    words = vocabulary.select("token").distinct().withColumn("known", F.lit(True))
    if words.limit(size_limit + 1).count() <= size_limit:
        words = F.broadcast(words)
    joined = tokens.join(words, "token", "left")
    return joined.withColumn("token", F.when(F.col("known"), F.col("token")).otherwise("<oov>")).drop("known")


def pad_start(tokens: DataFrame, doc: str, copies: int = 1) -> DataFrame:
    """Puts <s> before each document's tokens, at positions up to 0."""
    others = [c for c in tokens.columns if c not in ("pos", "token")]
    heads = tokens.filter("pos = 1").select(*others, F.explode(F.sequence(F.lit(1 - copies), F.lit(0))).cast("long").alias("pos"), F.lit("<s>").alias("token"))
    return tokens.select(*others, "pos", "token").unionByName(heads)
