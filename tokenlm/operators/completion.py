"""Completions at a cursor: the document as it stands is counted in place of its last version, and the search starts left of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators import counts as C
from tokenlm.operators import deltas, lexer, search

#: Completions that are sent, and what separates them.
SHOWN, SEPARATOR = 50, "\x1e"


def position(locations: list[int], cursor: int) -> int:
    """Number of tokens left of a cursor; one that starts at it is right of it."""
    return sum(loc < cursor for loc in locations)


def split_grams(tokens: DataFrame, cursor: DataFrame, order: int) -> DataFrame:
    """Gram rows of tokens that a cursor splits: no n-gram crosses it, and those right of it start afresh.

    cursor: corpus, doc and split, the number of tokens left of the cursor."""
    sides = tokens.join(cursor, ["corpus", "doc"]).withColumn("right", F.col("pos") > F.col("split"))
    left = C.grams(sides.filter("NOT right").select("corpus", "doc", "pos", "token"), order)
    right = C.grams(sides.filter("right").select("corpus", "doc", "pos", "token"), order)
    return left.unionByName(right)


def parameters(query: str) -> dict[str, str]:
    """Fields of a request's query string, decoded."""
    from urllib.parse import parse_qsl

    return dict(parse_qsl(query, keep_blank_values=True))


def complete(counted: DataFrame, corpus: str, path: str, text: str, cursor: int, base: str = "", old: str | None = None, threshold: float = search.THRESHOLD, branching: int = search.BRANCHING, depth: int = search.DEPTH) -> DataFrame:
    """path (tokens), prob, exclusive_prob, text and place, best first, at most SHOWN, for one cursor in one document.

    counted: gram counts of order 2 of all documents. old: the version of the document that they hold, if they hold one.
    base: what has been typed of the next token, which is left of the cursor but not in the text.
    """
    spark = counted.sparkSession
    kind = "corpus string, doc string, pos long, token string"

    def table(version: str):
        return spark.createDataFrame([(corpus, path, k, t.token) for k, t in enumerate(lexer.tokenize(version, path, begins=0), 1)], kind)

    found = lexer.tokenize(text, path, begins=0)
    split = position([t.loc for t in found], cursor)
    changes = [counted] + [deltas.signed(C.grams(table(old), 2), -1)] * (old is not None)
    cut = spark.createDataFrame([(corpus, path, split)], "corpus string, doc string, split long")
    now = deltas.applied(*changes, deltas.signed(split_grams(table(text), cut, 2), 1))
    last = found[split - 1].token if split else ""
    stop = spark.createDataFrame([(1, found[split].token)] if split < len(found) else [], "ctx_id int, token string")
    start = spark.createDataFrame([(1, corpus, last)], "ctx_id int, corpus string, last string")
    paths = search.paths(start, search.next_tokens(now), stop, threshold, branching, depth, base=base, least=SHOWN)
    pieces = F.split("path", " ")
    return ranked(paths.withColumn("text", lexer.detokenized(pieces)), SHOWN)


def ranked(paths: DataFrame, most: int = SHOWN) -> DataFrame:
    """The completions of a context by exclusive probability, ties by path, with place from 0."""
    place = F.row_number().over(Window.partitionBy("ctx_id").orderBy(F.desc(F.round("exclusive_prob", 9)), "path")) - 1
    return paths.withColumn("place", place).filter(F.col("place") < most)


def sent(completions: DataFrame) -> DataFrame:
    """One string per context: the texts of its completions, best first."""
    listed = F.sort_array(F.collect_list(F.struct("place", "text")))
    return completions.groupBy("ctx_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), SEPARATOR).alias("answer"))


def report(completions: DataFrame) -> DataFrame:
    """A JSON line per completion: its pieces, place and probabilities, and the other tokens that its last piece competes with."""
    parent = F.when(F.col("length") > 1, F.regexp_replace("path", r" [^ ]+$", "")).otherwise("")
    rows = completions.withColumn("parent", parent).withColumn("piece", F.substring_index("path", " ", -1))
    others = rows.groupBy("ctx_id", "parent").agg(F.sort_array(F.collect_list(F.struct("place", F.col("piece").alias("token"), "prob"))).alias("alternatives"))
    return rows.join(others, ["ctx_id", "parent"]).select("ctx_id", "place", F.to_json(F.struct(F.split("path", " ").alias("pieces"), "prob", "exclusive_prob", "alternatives")).alias("json"))

