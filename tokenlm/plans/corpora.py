"""Token tables made from the driver's tables, in Spark and in SQL.

words: tokens of all documents by language. clicks: event types of all events, one document per user in the order of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators import counts as C
from tokenlm.operators.tokens import PATTERN, lex
from tokenlm.sources.shared import written


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, before: int = 0) -> DataFrame:
    """corpus (language), doc, pos, token, and so many tokens before it."""
    return lex(read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("doc"), "text"), before=before)


def counted_words(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    return counted(words(spark, sf_dir, order - 1), order)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus 'events', doc (user), pos, token (event type)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.lit("events").alias("corpus"), F.col("user_id").alias("doc"), F.row_number().over(w).cast("long").alias("pos"), F.col("event_type").alias("token"))


def counted(tokens: DataFrame, order: int) -> DataFrame:
    """Gram counts, written once for the queries that join them several times."""
    return written(C.ngram_counts(C.grams(tokens, order)), "counts")


WORDS = f"""words AS (SELECT lang AS corpus, doc_id AS doc, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token
  FROM (SELECT lang, doc_id, regexp_extract_all(text, '{PATTERN}') AS t FROM documents))"""
CLICKS = """clicks AS (SELECT 'events' AS corpus, user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  event_type AS token FROM events)"""


def grams_sql(source: str, order: int) -> str:
    """CTEs lagged and grams."""
    lags = "".join(f", lag(token, {k}) OVER w AS p{k}" for k in range(1, order))
    parts = []
    for n in range(1, order + 1):
        before = [f"p{k}" for k in range(n - 1, 0, -1)]
        text = lambda xs: " || ' ' || ".join(xs) if xs else "''"
        whole = f"k {'=' if n < order else '>='} {n}"
        parts.append(f"SELECT corpus, doc, pos, {n} AS n, {text([*before, 'token'])} AS ngram, {text(before)} AS ctx, {text([*before, 'token'][1:])} AS back, {whole} AS whole FROM lagged WHERE k >= {n}")
    return f"lagged AS (SELECT corpus, doc, pos, token, row_number() OVER w AS k{lags} FROM {source} WINDOW w AS (PARTITION BY corpus, doc ORDER BY pos)),\ngrams AS ({' UNION ALL '.join(parts)})"


#: CTEs over grams: counts, contexts, continuation counts and totals, counts of counts, discounts.
STATS = """cnt AS (SELECT corpus, n, ngram, ctx, back, count(*) AS c, sum(CASE WHEN whole THEN 1 ELSE 0 END) AS w FROM grams GROUP BY corpus, n, ngram, ctx, back),
ctxs AS (SELECT corpus, n, ctx, sum(c) AS total, count(*) AS followers FROM cnt GROUP BY corpus, n, ctx),
pred AS (SELECT corpus, n - 1 AS n, back AS ngram, count(*) AS kd FROM cnt WHERE n > 1 GROUP BY corpus, n - 1, back),
kns AS (SELECT a.corpus, a.n, a.ngram, a.ctx, a.back, coalesce(p.kd, 0) + a.w AS kn FROM cnt a LEFT JOIN pred p ON p.corpus = a.corpus AND p.n = a.n AND p.ngram = a.ngram),
knt AS (SELECT corpus, n, ctx, sum(kn) AS kn_total FROM kns GROUP BY corpus, n, ctx),
coc AS (SELECT corpus, 'raw' AS kind, n, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2 FROM cnt GROUP BY corpus, n
  UNION ALL SELECT corpus, 'kn', n, count(*) FILTER (WHERE kn = 1), count(*) FILTER (WHERE kn = 2) FROM kns GROUP BY corpus, n),
disc AS (SELECT corpus, kind, n, CASE WHEN n1 > 0 AND n2 > 0 THEN n1::DOUBLE / (n1 + 2 * n2) ELSE 0::DOUBLE END AS discount FROM coc),
voc AS (SELECT corpus, count(*) AS v FROM cnt WHERE n = 1 GROUP BY corpus)"""


def levels_sql(order: int) -> str:
    """CTEs l1 to l<order>: interpolated Kneser-Ney probabilities."""
    out = []
    for n in range(1, order + 1):
        full = n == order
        x, total, kind, table = ("c", "t.total", "raw", "cnt") if full else ("kn", "k.kn_total", "kn", "kns")
        knt = "" if full else " JOIN knt k ON k.corpus = a.corpus AND k.n = a.n AND k.ctx = a.ctx"
        lower = "1::DOUBLE / v.v" if n == 1 else "b.p"
        below = "JOIN voc v ON v.corpus = a.corpus" if n == 1 else f"JOIN l{n - 1} b ON b.corpus = a.corpus AND b.ngram = a.back"
        out.append(f"""l{n} AS (SELECT a.corpus, a.ngram, a.{x} AS x, {total} AS total,
  CASE WHEN {total} > 0 THEN (greatest(a.{x} - d.discount, 0::DOUBLE) + d.discount * t.followers * ({lower})) / {total} ELSE {lower} END AS p
  FROM {table} a JOIN ctxs t ON t.corpus = a.corpus AND t.n = a.n AND t.ctx = a.ctx{knt} JOIN disc d ON d.corpus = a.corpus AND d.n = a.n AND d.kind = '{kind}' {below} WHERE a.n = {n})""")
    return ",\n".join(out)
