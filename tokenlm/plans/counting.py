"""Queries over tokens, n-gram statistics and Kneser-Ney probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenlm.functions import scalars as S
from tokenlm.operators import candidates as K
from tokenlm.operators import counts as C
from tokenlm.operators import deltas, kneser_ney, packed, prequential, rewriting, runs
from tokenlm.operators import features as G
from tokenlm.sources.shared import written
from tokenlm.plans.corpora import CLICKS, STATS, WORDS, clicks, counted, counted_words, grams_sql, levels_sql, read, words

QUERIES, SQL = {}, {}
TRI = f"WITH {WORDS},\n{grams_sql('words', 3)},\n{STATS}"
BI = f"WITH {WORDS},\n{grams_sql('words', 2)},\n{STATS}"
EV = f"WITH {CLICKS},\n{grams_sql('clicks', 3)},\n{STATS}"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@query("token_counts_by_lang", f"WITH {WORDS} SELECT corpus AS lang, token, count(*) AS c FROM words GROUP BY corpus, token")
def token_counts_by_lang(spark, sf_dir):
    return words(spark, sf_dir).groupBy(F.col("corpus").alias("lang"), "token").agg(F.count("*").alias("c"))


@query("top_tokens", f"WITH {WORDS} SELECT token, count(*) AS c FROM words GROUP BY token ORDER BY c DESC, token LIMIT 1000")
def top_tokens(spark, sf_dir):
    return rewriting.common_tokens(words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("c")), 1000)


@query("token_types", f"""WITH {WORDS} SELECT corpus, CAST(sum(CASE WHEN regexp_matches(token, '^\\w+$') THEN 1 ELSE 0 END) AS BIGINT) AS identifiers,
  CAST(sum(CASE WHEN regexp_matches(token, '^[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS numbers, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM words GROUP BY corpus""")
def token_types(spark, sf_dir):
    n = lambda c: F.sum(c.cast("long"))
    t = F.col("token")
    return words(spark, sf_dir).groupBy("corpus").agg(n(S.is_identifier(t)).alias("identifiers"), n(t.rlike("^[0-9]")).alias("numbers"), F.count("*").alias("tokens"), F.count_distinct("token").alias("distinct_tokens"))


def _ngrams(order):
    sql = f"WITH {WORDS},\n{grams_sql('words', order)} SELECT corpus, ngram, count(*) AS c FROM grams WHERE n = {order} GROUP BY corpus, ngram"

    @query(f"ngram_counts_{order}", sql)
    def run(spark, sf_dir):
        return C.grams(words(spark, sf_dir, order - 1), order, order).groupBy("corpus", "ngram").agg(F.count("*").alias("c"))


for _n in (1, 2, 3, 4):
    _ngrams(_n)


@query("context_totals", f"{TRI} SELECT corpus, n, ctx, CAST(total AS BIGINT) AS total FROM ctxs")
def context_totals(spark, sf_dir):
    return C.contexts(counted_words(spark, sf_dir, 3)).select("corpus", "n", "ctx", "total")


@query("distinct_followers", f"{TRI} SELECT corpus, n, ctx, followers FROM ctxs")
def distinct_followers(spark, sf_dir):
    return C.contexts(counted_words(spark, sf_dir, 3)).select("corpus", "n", "ctx", "followers")


@query("continuation_counts", f"{TRI} SELECT corpus, n, ngram, CAST(kn AS BIGINT) AS kn FROM kns")
def continuation_counts(spark, sf_dir):
    return C.continuations(counted_words(spark, sf_dir, 3)).select("corpus", "n", "ngram", "kn")


@query("continuation_totals", f"{TRI} SELECT corpus, n, ctx, CAST(kn_total AS BIGINT) AS kn_total FROM knt")
def continuation_totals(spark, sf_dir):
    return C.continuation_totals(C.continuations(counted_words(spark, sf_dir, 3)))


def _coc(spark, sf_dir):
    return C.counts_of_counts(C.continuations(counted_words(spark, sf_dir, 3)))


@query("counts_of_counts", f"{TRI} SELECT corpus, kind, n, n1, n2 FROM coc")
def counts_of_counts(spark, sf_dir):
    return _coc(spark, sf_dir)


@query("kn_discounts", f"{TRI} SELECT corpus, kind, n, round(discount, 9) AS discount FROM disc")
def kn_discounts(spark, sf_dir):
    return C.discounts(_coc(spark, sf_dir)).withColumn("discount", F.round("discount", 9))


def _prob(name, order, prefix):
    @query(name, f"{prefix},\n{levels_sql(order)} SELECT corpus, ngram, round(p, 9) AS p FROM l{order}")
    def run(spark, sf_dir):
        return kneser_ney.levels(counted_words(spark, sf_dir, order), order)[order].select("corpus", "ngram", F.round("p", 9).alias("p"))


_prob("kn_prob_bigram", 2, BI)
_prob("kn_prob_trigram", 3, TRI)


@query("kn_entropy_by_lang", f"""{TRI},
{levels_sql(3)},
every AS (SELECT a.corpus, a.w, b.p FROM cnt a JOIN l1 b ON a.n = 1 AND b.corpus = a.corpus AND b.ngram = a.ngram WHERE a.w > 0
  UNION ALL SELECT a.corpus, a.w, b.p FROM cnt a JOIN l2 b ON a.n = 2 AND b.corpus = a.corpus AND b.ngram = a.ngram WHERE a.w > 0
  UNION ALL SELECT a.corpus, a.w, b.p FROM cnt a JOIN l3 b ON a.n = 3 AND b.corpus = a.corpus AND b.ngram = a.ngram WHERE a.w > 0)
SELECT corpus AS lang, CAST(sum(w) AS BIGINT) AS n_tokens, round(sum(CASE WHEN p > 0 THEN -ln(p) * w END) / sum(CASE WHEN p > 0 THEN w END), 6) AS entropy FROM every GROUP BY corpus""")
def kn_entropy_by_lang(spark, sf_dir):
    return kneser_ney.entropy(counted_words(spark, sf_dir, 3), 3).select(F.col("corpus").alias("lang"), "n_tokens", F.round("entropy", 6).alias("entropy"))


@query("kn_explain", f"""{EV},
{levels_sql(3)}
SELECT a.corpus, a.ngram, (CAST(x3.x AS BIGINT) || ':' || CAST(x3.total AS BIGINT)) || ' ' || (CAST(x2.x AS BIGINT) || ':' || CAST(x2.total AS BIGINT)) || ' ' || (CAST(x1.x AS BIGINT) || ':' || CAST(x1.total AS BIGINT)) AS levels
FROM cnt a JOIN l3 x3 ON x3.ngram = a.ngram JOIN l2 x2 ON x2.ngram = a.back JOIN l1 x1 ON x1.ngram = split_part(a.ngram, ' ', 3) WHERE a.n = 3""")
def kn_explain(spark, sf_dir):
    return kneser_ney.explain(counted(clicks(spark, sf_dir), 3), 3)


@query("longest_seen_context", f"""WITH {WORDS},
bench AS (SELECT 'en' AS corpus, item_id AS doc, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token FROM (SELECT item_id, regexp_extract_all(text, '{{pattern}}') AS t FROM benchmark)),
wl AS MATERIALIZED (SELECT corpus, token, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2 FROM words WINDOW w AS (PARTITION BY corpus, doc ORDER BY pos)),
known AS MATERIALIZED (SELECT DISTINCT corpus, '' AS ctx FROM words UNION SELECT DISTINCT corpus, p1 FROM wl WHERE p1 IS NOT NULL UNION SELECT DISTINCT corpus, p2 || ' ' || p1 FROM wl WHERE p2 IS NOT NULL),
bl AS (SELECT corpus, doc, pos, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2 FROM bench WINDOW w AS (PARTITION BY corpus, doc ORDER BY pos))
SELECT b.doc, b.pos, CAST(CASE WHEN k2.ctx IS NOT NULL THEN 2 WHEN k1.ctx IS NOT NULL THEN 1 WHEN k0.ctx IS NOT NULL THEN 0 ELSE -1 END AS INTEGER) AS context_max_n
FROM bl b LEFT JOIN known k2 ON k2.corpus = b.corpus AND k2.ctx = b.p2 || ' ' || b.p1 LEFT JOIN known k1 ON k1.corpus = b.corpus AND k1.ctx = b.p1 LEFT JOIN known k0 ON k0.corpus = b.corpus AND k0.ctx = ''""".replace("{pattern}", WORDS.split("text, '")[1].split("') AS t")[0]))
def longest_seen_context(spark, sf_dir):
    from tokenlm.operators.tokens import lex

    bench = lex(read(spark, sf_dir, "benchmark").select(F.lit("en").alias("corpus"), F.col("item_id").alias("doc"), "text"), before=2)
    return kneser_ney.longest_seen(C.grams(bench, 3), counted_words(spark, sf_dir, 3), 3).select("doc", "pos", "context_max_n")


MODIFIED = """m AS (SELECT corpus, n, count(*) FILTER (WHERE c = 1)::DOUBLE AS n1, count(*) FILTER (WHERE c = 2)::DOUBLE AS n2, count(*) FILTER (WHERE c = 3)::DOUBLE AS n3, count(*) FILTER (WHERE c = 4)::DOUBLE AS n4 FROM cnt GROUP BY corpus, n),
my AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN n1 / (n1 + 2 * n2) END AS y FROM m),
md0 AS (SELECT corpus, n, CASE WHEN n1 > 0 THEN 1 - 2 * y * n2 / n1 END AS e1, CASE WHEN n2 > 0 THEN 2 - 3 * y * n3 / n2 END AS e2, CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 END AS e3 FROM my),
md AS MATERIALIZED (SELECT corpus, n, CASE WHEN e1 BETWEEN 0 AND 1 THEN e1 ELSE 0.5::DOUBLE END AS d1, CASE WHEN e2 BETWEEN 0 AND 1 THEN e2 ELSE 0.5::DOUBLE END AS d2, CASE WHEN e3 BETWEEN 0 AND 1 THEN e3 ELSE 0.5::DOUBLE END AS d3 FROM md0)"""


@query("modified_kn_discounts", f"{TRI},\n{MODIFIED} SELECT corpus, n, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM md")
def modified_kn_discounts(spark, sf_dir):
    return kneser_ney.modified_discounts(counted_words(spark, sf_dir, 3)).select("corpus", "n", *[F.round(d, 9).alias(d) for d in ("d1", "d2", "d3")])


def _modified_sql():
    out = ["pool AS MATERIALIZED (SELECT z.corpus || '|' || z.n || '|' || z.ctx AS k, sum(z.c) AS total, max(d.d1) AS d1, max(d.d2) AS d2, max(d.d3) AS d3, max(d.d1) * count(*) FILTER (WHERE z.c = 1) + max(d.d2) * count(*) FILTER (WHERE z.c = 2) + max(d.d3) * count(*) FILTER (WHERE z.c >= 3) AS pool FROM cnt z JOIN md d ON d.corpus = z.corpus AND d.n = z.n GROUP BY z.corpus, z.n, z.ctx)"]
    for n in (1, 2, 3):
        below, lower = ("JOIN voc v ON v.corpus = a.corpus", "1::DOUBLE / v.v") if n == 1 else (f"JOIN q{n - 1} b ON b.k = a.corpus || '|' || a.back", "b.p")
        out.append(f"q{n} AS MATERIALIZED (SELECT a.corpus || '|' || a.ngram AS k, a.corpus, a.ngram, (a.c - CASE a.c WHEN 1 THEN o.d1 WHEN 2 THEN o.d2 ELSE o.d3 END + o.pool * {lower}) / o.total AS p FROM cnt a JOIN pool o ON o.k = a.corpus || '|' || a.n || '|' || a.ctx {below} WHERE a.n = {n})")
    return ",\n".join(out)


@query("modified_kn_prob", f"{TRI},\n{MODIFIED},\n{_modified_sql()} SELECT corpus, ngram, round(p, 9) AS p FROM q3")
def modified_kn_prob(spark, sf_dir):
    return kneser_ney.modified(counted_words(spark, sf_dir, 3), 3).select("corpus", "ngram", F.round("p", 9).alias("p"))


@query("files_per_token", f"WITH {WORDS} SELECT corpus, token, count(DISTINCT doc) AS docs, count(*) AS c FROM words GROUP BY corpus, token")
def files_per_token(spark, sf_dir):
    return C.documents_per_token(words(spark, sf_dir))


RARE_SQL = """rare AS (SELECT v.corpus, v.ngram AS token, CAST(coalesce(k.kn_total, 0) AS BIGINT) AS kn_total FROM (SELECT corpus, ngram FROM cnt WHERE n = 1) v LEFT JOIN (SELECT * FROM knt WHERE n = 2) k ON k.corpus = v.corpus AND k.ctx = v.ngram WHERE coalesce(k.kn_total, 0) < 6 - 1e-4 AND v.ngram <> '<s>')"""


def _rare(spark, sf_dir):
    c = counted_words(spark, sf_dir, 3)
    return rewriting.rare_online(C.continuation_totals(C.continuations(c)), c.filter("n = 1").select("corpus", F.col("ngram").alias("token")))


@query("rare_tokens_online", f"{TRI},\n{RARE_SQL} SELECT corpus, token, kn_total FROM rare")
def rare_tokens_online(spark, sf_dir):
    return _rare(spark, sf_dir)


COMMON_SQL = "common AS (SELECT token FROM (SELECT token, count(*) AS c FROM words GROUP BY token) ORDER BY c DESC, token LIMIT 500)"


def _common(tokens, size=500):
    return rewriting.common_tokens(tokens.groupBy("token").agg(F.count("*").alias("c")), size)


@query("rare_tokens_fixed", f"WITH {WORDS},\n{COMMON_SQL} SELECT DISTINCT w.corpus, w.token FROM words w LEFT JOIN common k ON k.token = w.token WHERE k.token IS NULL")
def rare_tokens_fixed(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.select("corpus", "token").distinct().join(F.broadcast(_common(w)), "token", "left_anti")


@query("rare_rewrite_bigrams", f"WITH {WORDS},\n{COMMON_SQL},\nmarked AS (SELECT w.corpus, w.doc, w.pos, CASE WHEN k.token IS NULL THEN '<rare>' ELSE w.token END AS token FROM words w LEFT JOIN common k ON k.token = w.token),\n{grams_sql('marked', 2)} SELECT corpus, ngram, count(*) AS c FROM grams WHERE n = 2 GROUP BY corpus, ngram")
def rare_rewrite_bigrams(spark, sf_dir):
    w = words(spark, sf_dir)
    return C.grams(rewriting.rewrite_rare(w, _common(w)), 2).filter("n = 2").groupBy("corpus", "ngram").agg(F.count("*").alias("c"))


@query("filename_rewrite", """WITH parts AS (SELECT p_partkey AS doc, p_type AS corpus, string_split(p_name, ' ') AS t FROM part),
rows_ AS (SELECT corpus, doc, unnest(t) AS token, t[1] AS name FROM parts)
SELECT CASE WHEN token = name THEN '<fileName>' ELSE token END AS token, count(*) AS c, count(DISTINCT corpus) AS corpora FROM rows_ GROUP BY 1""")
def filename_rewrite(spark, sf_dir):
    t = F.split("p_name", " ")
    rows = read(spark, sf_dir, "part").select(F.col("p_type").alias("corpus"), F.col("p_partkey").alias("doc"), F.explode(t).alias("token"), t[0].alias("name"))
    return rewriting.rewrite_file_name(rows).groupBy("token").agg(F.count("*").alias("c"), F.count_distinct("corpus").alias("corpora"))


@query("pattern_rewrite", f"""{TRI},
{RARE_SQL},
marked AS (SELECT w.corpus, w.doc, w.pos, w.token, r.token IS NOT NULL AS r FROM words w LEFT JOIN rare r ON r.corpus = w.corpus AND r.token = w.token),
wide AS (SELECT corpus, token AS t0, r AS r0, lag(token, 1) OVER q AS t1, lag(r, 1) OVER q AS r1, lag(token, 2) OVER q AS t2, lag(r, 2) OVER q AS r2 FROM marked WINDOW q AS (PARTITION BY corpus, doc ORDER BY pos))
SELECT corpus, (CASE WHEN NOT r2 THEN t2 WHEN r1 AND t1 = t2 THEN '<0>' WHEN r1 THEN '<1>' ELSE '<0>' END) || ' ' || (CASE WHEN r1 THEN '<0>' ELSE t1 END) || ' ' ||
  (CASE WHEN NOT r0 THEN t0 WHEN r1 AND t0 = t1 THEN '<0>' WHEN r2 AND t0 = t2 THEN (CASE WHEN r1 THEN '<1>' ELSE '<0>' END) ELSE '<rare>' END) AS ngram, count(*) AS c
FROM wide WHERE t2 IS NOT NULL GROUP BY 1, 2""")
def pattern_rewrite(spark, sf_dir):
    tokens = words(spark, sf_dir, 2)
    common = written(rewriting.common_online(C.continuation_totals(C.continuations(counted(tokens, 3)))), "common")
    rows = rewriting.pattern_rows(rewriting.flagged(tokens, common, 3), 3).filter("k = 3")
    return rows.groupBy("corpus", "ngram").agg(F.count("*").alias("c"))


@query("followers", f"{TRI} SELECT DISTINCT corpus, n, ctx, split_part(ngram, ' ', n) AS token FROM cnt")
def followers(spark, sf_dir):
    return C.followers(C.grams(words(spark, sf_dir, 2), 3))


@query("cumulative_count_dump", f"{BI},\nd AS (SELECT corpus, ngram, c, CAST(sum(c) OVER (PARTITION BY corpus ORDER BY c DESC, ngram ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM cnt WHERE n = 1) SELECT * FROM d WHERE c > 2.9999")
def cumulative_count_dump(spark, sf_dir):
    return C.cumulative_dump(counted_words(spark, sf_dir, 2).filter("n = 1"))


RECENCY_SQL = f"""WITH {WORDS},
b AS (SELECT *, coalesce(lag(token, 1) OVER (PARTITION BY corpus, doc ORDER BY pos), '') AS before FROM words),
r AS (SELECT *, lag(pos, 1) OVER q AS lp, lag(before, 1) OVER q AS lb FROM b WINDOW q AS (PARTITION BY corpus, doc, token ORDER BY pos)),
rec AS (SELECT corpus, doc, pos, token, pos - lp AS distance, CASE WHEN pos - lp <= 30 THEN 'inLast30' WHEN lp IS NOT NULL THEN 'inFile' END AS flag,
  CASE WHEN lp IS NULL THEN 'notInFile' WHEN pos - lp <= 10 THEN 'last' || (pos - lp) ELSE 'last.log' END AS feature, CASE WHEN lp IS NULL OR pos - lp <= 10 THEN 1::DOUBLE ELSE ln((pos - lp)::DOUBLE) END AS value, coalesce(before = lb, FALSE) AS last_bigram FROM r)"""


@query("recency_flags", f"{RECENCY_SQL} SELECT corpus, flag, last_bigram, count(*) AS n FROM rec GROUP BY corpus, flag, last_bigram")
def recency_flags(spark, sf_dir):
    return G.recency(words(spark, sf_dir)).groupBy("corpus", "flag", "last_bigram").agg(F.count("*").alias("n"))


@query("recency_distance", f"{RECENCY_SQL} SELECT corpus, doc, pos, feature, round(value, 9) AS value FROM rec")
def recency_distance(spark, sf_dir):
    return G.recency(words(spark, sf_dir)).select("corpus", "doc", "pos", "feature", F.round("value", 9).alias("value"))


@query("recency_histogram", f"{RECENCY_SQL} SELECT corpus, distance, count(*) AS n FROM rec WHERE distance BETWEEN 1 AND 499 GROUP BY corpus, distance")
def recency_histogram(spark, sf_dir):
    return G.recency_histogram(words(spark, sf_dir))


BIN_CASE = "CASE " + " ".join(f"WHEN total <= {b} THEN '<={b}'" for b in S.BINS) + f" ELSE '>{S.BINS[-1]}' END"


@query("bin_annotation", f"""{TRI},
best AS (SELECT g.corpus, g.doc, g.pos, max(g.n) AS n FROM grams g WHERE g.n > 1 GROUP BY g.corpus, g.doc, g.pos)
SELECT g.corpus, g.doc, g.pos, CASE WHEN b.n IS NULL THEN ',empty' ELSE ',total' || (b.n - 1) || {BIN_CASE.replace("total", "t.total")} END AS annotation
FROM (SELECT corpus, doc, pos FROM grams WHERE n = 1) g LEFT JOIN best b ON b.corpus = g.corpus AND b.doc = g.doc AND b.pos = g.pos
LEFT JOIN grams x ON x.corpus = b.corpus AND x.doc = b.doc AND x.pos = b.pos AND x.n = b.n LEFT JOIN ctxs t ON t.corpus = x.corpus AND t.n = x.n AND t.ctx = x.ctx""")
def bin_annotation(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("doc"), "text")
    return packed.context_bins(docs)


PREQ = f"""WITH {CLICKS},
sized AS (SELECT doc, count(*) AS m FROM clicks GROUP BY doc),
starts AS (SELECT doc, coalesce(sum(m) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sized),
{grams_sql('clicks', 3)},
gg AS (SELECT g.*, CAST(s.s + g.pos AS BIGINT) AS g FROM grams g JOIN starts s ON s.doc = g.doc),
c0 AS (SELECT *, count(*) OVER (PARTITION BY n, ngram ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM gg),
c1 AS (SELECT *, CASE WHEN c = 0 THEN 1 ELSE 0 END AS new FROM c0),
c2 AS (SELECT a.*, CASE WHEN a.whole THEN 1 ELSE coalesce(b.new, 0) END AS kd FROM c1 a LEFT JOIN c1 b ON b.g = a.g AND b.n = a.n + 1),
past AS (SELECT corpus, doc, pos, g, n, ngram, c, count(*) OVER q AS total, CAST(coalesce(sum(new) OVER q, 0) AS BIGINT) AS followers,
  CAST(coalesce(sum(kd) OVER (PARTITION BY n, ngram ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS kn, CAST(coalesce(sum(kd) OVER q, 0) AS BIGINT) AS kn_total
  FROM c2 WINDOW q AS (PARTITION BY n, ctx ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _before(spark, sf_dir):
    t = prequential.numbered(clicks(spark, sf_dir))
    return prequential.counts_before(C.grams(t, 3), t)


@query("prequential_counts", f"{PREQ} SELECT g, n, ngram, c, total, followers, kn, kn_total FROM past")
def prequential_counts(spark, sf_dir):
    return _before(spark, sf_dir).select("g", "n", "ngram", "c", "total", "followers", "kn", "kn_total")


@query("prequential_entropy", f"""{PREQ},
p1 AS (SELECT g, followers, CASE WHEN kn_total > 0 THEN (greatest(kn - 0.5::DOUBLE, 0) + 0.5::DOUBLE * followers * (1::DOUBLE / (followers + 1))) / kn_total ELSE 1::DOUBLE / (followers + 1) END AS p FROM past WHERE n = 1),
p2 AS (SELECT a.g, CASE WHEN b.kn_total > 0 THEN (greatest(b.kn - 0.5::DOUBLE, 0) + 0.5::DOUBLE * b.followers * a.p) / b.kn_total ELSE a.p END AS p FROM p1 a LEFT JOIN past b ON b.g = a.g AND b.n = 2),
p3 AS (SELECT a.g, CASE WHEN b.total > 0 THEN (greatest(b.c - 0.5::DOUBLE, 0) + 0.5::DOUBLE * b.followers * a.p) / b.total ELSE a.p END AS p FROM p2 a LEFT JOIN past b ON b.g = a.g AND b.n = 3)
SELECT 'events' AS corpus, count(*) AS n_tokens, round(avg(-ln(p)), 6) AS entropy FROM p3""")
def prequential_entropy(spark, sf_dir):
    return prequential.entropy(_before(spark, sf_dir), 3).withColumn("entropy", F.round("entropy", 6))


WORD_PREQ = f"""WITH {WORDS},
sized AS (SELECT corpus, doc, count(*) AS m FROM words GROUP BY corpus, doc),
starts AS (SELECT corpus, doc, coalesce(sum(m) OVER (PARTITION BY corpus ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sized),
{grams_sql('words', 3)},
gg AS (SELECT g.*, CAST(s.s + g.pos AS BIGINT) AS g FROM grams g JOIN starts s ON s.corpus = g.corpus AND s.doc = g.doc),
c0 AS (SELECT *, count(*) OVER (PARTITION BY corpus, n, ngram ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM gg),
c1 AS (SELECT *, CASE WHEN c = 0 THEN 1 ELSE 0 END AS new FROM c0),
c2 AS (SELECT a.*, CASE WHEN a.whole THEN 1 ELSE coalesce(b.new, 0) END AS kd FROM c1 a LEFT JOIN c1 b ON b.corpus = a.corpus AND b.g = a.g AND b.n = a.n + 1),
past AS (SELECT corpus, doc, pos, g, n, ngram, c, count(*) OVER q AS total, CAST(coalesce(sum(new) OVER q, 0) AS BIGINT) AS followers,
  CAST(coalesce(sum(kd) OVER (PARTITION BY corpus, n, ngram ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS kn, CAST(coalesce(sum(kd) OVER q, 0) AS BIGINT) AS kn_total
  FROM c2 WINDOW q AS (PARTITION BY corpus, n, ctx ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _word_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("doc"), "text")


@query("word_prequential_counts", f"{WORD_PREQ} SELECT corpus, g, n, ngram, c, total, followers, kn, kn_total FROM past")
def word_prequential_counts(spark, sf_dir):
    return runs.counts(_word_docs(spark, sf_dir))


@query("word_prequential_entropy", f"""{WORD_PREQ},
p1 AS (SELECT corpus, g, followers, CASE WHEN kn_total > 0 THEN (greatest(kn - 0.5::DOUBLE, 0) + 0.5::DOUBLE * followers * (1::DOUBLE / (followers + 1))) / kn_total ELSE 1::DOUBLE / (followers + 1) END AS p FROM past WHERE n = 1),
p2 AS (SELECT a.corpus, a.g, CASE WHEN b.kn_total > 0 THEN (greatest(b.kn - 0.5::DOUBLE, 0) + 0.5::DOUBLE * b.followers * a.p) / b.kn_total ELSE a.p END AS p FROM p1 a LEFT JOIN past b ON b.corpus = a.corpus AND b.g = a.g AND b.n = 2),
p3 AS (SELECT a.corpus, a.g, CASE WHEN b.total > 0 THEN (greatest(b.c - 0.5::DOUBLE, 0) + 0.5::DOUBLE * b.followers * a.p) / b.total ELSE a.p END AS p FROM p2 a LEFT JOIN past b ON b.corpus = a.corpus AND b.g = a.g AND b.n = 3)
SELECT corpus, count(*) AS n_tokens, round(avg(-ln(p)), 6) AS entropy FROM p3 GROUP BY corpus""")
def word_prequential_entropy(spark, sf_dir):
    return runs.entropy(_word_docs(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query("retract_update", f"""WITH base AS (SELECT lang AS corpus, doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN upper(text) ELSE text END AS text FROM documents),
words AS (SELECT corpus, doc, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token FROM (SELECT corpus, doc, regexp_extract_all(text, '{WORDS.split("text, '")[1].split("') AS t")[0]}') AS t FROM base)),
{grams_sql('words', 2)},
{STATS} SELECT corpus, n, ngram, c, CAST(w AS BIGINT) AS w FROM cnt""")
def retract_update(spark, sf_dir):
    """Every second document is replaced by its text in capitals; counts follow from signed rows."""
    from tokenlm.operators.tokens import lex

    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("doc"), "text")
    changed = docs.filter("doc % 2 = 0")
    new = changed.withColumn("text", S.upper_by_character(F.col("text")))
    return deltas.update(counted(lex(docs, before=1), 2), lex(changed, before=1), lex(new, before=1), 2).select("corpus", "n", "ngram", "c", "w")


# --- candidates over event types: small vocabulary, all contexts ---

CAND = f"""{EV},
ctx AS (SELECT corpus, doc, pos, token AS truth, p1, p2 FROM lagged),
foll AS (SELECT DISTINCT n, ctx, split_part(ngram, ' ', n) AS cand FROM cnt),
staged AS (SELECT corpus, doc, pos, truth, cand, min(stage) AS stage, any_value(p1) AS p1, any_value(p2) AS p2 FROM (
  SELECT c.*, f.cand, 0 AS stage FROM ctx c JOIN foll f ON f.n = 3 AND f.ctx = c.p2 || ' ' || c.p1
  UNION ALL SELECT c.*, f.cand, 1 FROM ctx c JOIN foll f ON f.n = 2 AND f.ctx = c.p1
  UNION ALL SELECT c.*, e.token, 2 FROM ctx c JOIN (SELECT doc, token, min(pos) AS at FROM clicks GROUP BY doc, token) e ON e.doc = c.doc AND e.at < c.pos
  UNION ALL SELECT c.*, v.token, 3 FROM ctx c CROSS JOIN (SELECT DISTINCT token FROM clicks) v) GROUP BY corpus, doc, pos, truth, cand),
sc AS (SELECT s.*, coalesce(a.c, 0) AS c1, coalesce(b.c, 0) AS c2, coalesce(d.c, 0) AS c3 FROM staged s LEFT JOIN cnt a ON a.n = 1 AND a.ngram = s.cand LEFT JOIN cnt b ON b.n = 2 AND b.ngram = s.p1 || ' ' || s.cand LEFT JOIN cnt d ON d.n = 3 AND d.ngram = s.p2 || ' ' || s.p1 || ' ' || s.cand),
scored AS (SELECT *, 0.5::DOUBLE * ln(c1 + 1::DOUBLE) + 0.7::DOUBLE * ln(c2 + 1::DOUBLE) + 0.9::DOUBLE * ln(c3 + 1::DOUBLE) AS score FROM sc),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc, pos)) AS e FROM scored),
ranked AS (SELECT *, e / sum(e) OVER (PARTITION BY doc, pos) AS prob, row_number() OVER (PARTITION BY doc, pos ORDER BY round(score, 9) DESC, cand) - 1 AS rank FROM ex),
states AS (SELECT c.corpus, c.doc, c.pos, c.truth, r.prob IS NOT NULL AS oracle, coalesce(r.rank = 0, FALSE) AS correct, r.rank, -ln(r.prob) AS entropy, coalesce(1::DOUBLE / (r.rank + 1), 0) AS rr FROM ctx c LEFT JOIN ranked r ON r.doc = c.doc AND r.pos = c.pos AND r.cand = c.truth)"""
WEIGHTS = {"c1": 0.5, "c2": 0.7, "c3": 0.9}


def values():
    return {f: F.log(F.col(f) + F.lit(1.0)) for f in WEIGHTS}


def _staged(spark, sf_dir, vocabulary=True):
    t = clicks(spark, sf_dir)
    return K.staged(t, C.followers(C.grams(t, 3)), vocabulary)


def _scored(spark, sf_dir):
    """The clicks, the followers and the counts are written first, so that no plan repeats the windows over the events."""
    t = written(clicks(spark, sf_dir), "clicks")
    known = written(C.followers(C.grams(t, 3)), "followers")
    return written(K.scored(K.staged(t, known), t, counted(t, 3)), "scored")


def ranked(spark, sf_dir):
    return K.softmax(K.log_linear(_scored(spark, sf_dir), WEIGHTS, values()))


def states(spark, sf_dir):
    return K.inferred(ranked(spark, sf_dir), K.context_rows(clicks(spark, sf_dir)).drop("p1", "p2"))


@query("candidates_staged", f"{CAND} SELECT doc, pos, cand, CAST(stage AS INTEGER) AS stage FROM staged")
def candidates_staged(spark, sf_dir):
    return _staged(spark, sf_dir).select("doc", "pos", "cand", "stage")


@query("candidates_prefix", f"""{CAND} SELECT doc, pos, cand, CAST(stage AS INTEGER) AS stage FROM staged WHERE starts_with(lower(cand), lower(substring(truth, 1, 1)))""")
def candidates_prefix(spark, sf_dir):
    return _staged(spark, sf_dir).filter(S.has_base(F.col("cand"), F.substring("truth", 1, 1))).select("doc", "pos", "cand", "stage")


@query("count_features", f"""{CAND},
f AS (SELECT doc, pos, cand, unnest(['count1', 'count2', 'count3']) AS f, unnest([c1, c2, c3]) AS c FROM sc)
SELECT doc, pos, cand, CASE WHEN c <= 2 THEN f || '=' || c ELSE f || '.log' END AS fname, round(CASE WHEN c <= 2 THEN 1::DOUBLE ELSE ln(c::DOUBLE) END, 9) AS fval FROM f""")
def count_features(spark, sf_dir):
    return G.count_features(_scored(spark, sf_dir), 3).select("doc", "pos", "cand", "fname", F.round("fval", 9).alias("fval"))


@query("num_features", f"""{CAND},
f AS (SELECT doc, pos, cand, unnest(['num1', 'num2', 'num3']) AS f, unnest([c1, c2, c3]) AS c FROM sc)
SELECT doc, pos, cand, CASE WHEN c >= 3 THEN f || '>=3' ELSE f || '=' || c END AS fname, 1::DOUBLE AS fval FROM f UNION ALL SELECT doc, pos, cand, f || '.log', round(ln(c + 1::DOUBLE), 9) FROM f""")
def num_features(spark, sf_dir):
    return G.num_features(_scored(spark, sf_dir), 3).select("doc", "pos", "cand", "fname", F.round("fval", 9).alias("fval"))


@query("loglinear_scores", f"{CAND} SELECT doc, pos, cand, round(score, 9) AS score FROM scored")
def loglinear_scores(spark, sf_dir):
    return K.log_linear(_scored(spark, sf_dir), WEIGHTS, values()).select("doc", "pos", "cand", F.round("score", 9).alias("score"))


@query("softmax_ranked", f"{CAND} SELECT doc, pos, cand, round(prob, 9) AS prob, CAST(rank AS INTEGER) AS rank FROM ranked")
def softmax_ranked(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc", "pos", "cand", F.round("prob", 9).alias("prob"), F.col("rank").cast("int").alias("rank"))


@query("top3_candidates", f"{CAND} SELECT doc, pos, string_agg(cand, ' ' ORDER BY rank) AS best FROM ranked WHERE rank < 3 GROUP BY doc, pos")
def top3_candidates(spark, sf_dir):
    best = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]), " ")
    return ranked(spark, sf_dir).filter("rank < 3").groupBy("doc", "pos").agg(best.alias("best"))


@query("top5_candidates", f"{CAND} SELECT doc, pos, string_agg(cand, ' ' ORDER BY rank) AS best FROM ranked WHERE rank < 5 GROUP BY doc, pos")
def top5_candidates(spark, sf_dir):
    best = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]), " ")
    return ranked(spark, sf_dir).filter("rank < 5").groupBy("doc", "pos").agg(best.alias("best"))


@query("eval_metrics", f"""{CAND} SELECT corpus, count(*) AS n_tokens, round(avg(CASE WHEN correct THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN oracle THEN 1::DOUBLE ELSE 0 END), 6) AS oracle, round(avg(rank), 6) AS rank, round(avg(rr), 6) AS reciprocal_rank, round(avg(entropy), 6) AS entropy,
  round(avg(CASE WHEN regexp_matches(truth, '^\\w+$') THEN CASE WHEN correct THEN 1::DOUBLE ELSE 0 END END), 6) AS ident_accuracy, round(avg(CASE WHEN regexp_matches(truth, '^\\w+$') THEN entropy END), 6) AS ident_entropy, round(exp(avg(entropy)), 6) AS perplexity FROM states GROUP BY corpus""")
def eval_metrics(spark, sf_dir):
    m = K.metrics(states(spark, sf_dir), ["corpus"])
    return m.select("corpus", "n_tokens", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


TYPED = "typed AS (SELECT *, row_number() OVER (PARTITION BY doc, pos, prefix ORDER BY rank) - 1 AS place FROM (SELECT r.*, unnest([0, 1, 2, 3]) AS prefix FROM ranked r) WHERE starts_with(lower(cand), lower(substring(truth, 1, prefix))))"


@query("topn_hits_by_prefix", f"{CAND},\n{TYPED} SELECT prefix, " + ", ".join(f"round(avg(CASE WHEN place < {n} THEN 1::DOUBLE ELSE 0 END), 6) AS top{n}" for n in (1, 2, 3, 4, 5)) + " FROM typed WHERE cand = truth GROUP BY prefix")
def topn_hits_by_prefix(spark, sf_dir):
    hits = K.typed_prefixes(ranked(spark, sf_dir)).filter("cand = truth")
    return hits.groupBy("prefix").agg(*[F.round(F.avg((F.col("place") < n).cast("double")), 6).alias(f"top{n}") for n in (1, 2, 3, 4, 5)])


@query("keystroke_savings", f"""{CAND},
{TYPED},
used AS (SELECT prefix, length(truth) AS size, CASE WHEN place < 5 THEN least(length(truth), prefix + 1 + least(place, 6 - place)) ELSE length(truth) END AS u FROM typed WHERE cand = truth)
SELECT prefix, CAST(sum(u) AS BIGINT) AS actual, CAST(sum(size) AS BIGINT) AS most, round(sum(size - u)::DOUBLE / count(*), 6) AS saved_per_token FROM used GROUP BY prefix""")
def keystroke_savings(spark, sf_dir):
    k = K.keystrokes(K.typed_prefixes(ranked(spark, sf_dir)).filter("cand = truth"))
    return k.select("prefix", "actual", "most", F.round("saved_per_token", 6).alias("saved_per_token"))


@query("off_beam_vs_oov", f"""{EV},
st AS (SELECT l.token AS truth, f.ngram IS NOT NULL AS oracle FROM lagged l LEFT JOIN cnt f ON f.n = 3 AND f.c > 5 AND f.ngram = l.p2 || ' ' || l.p1 || ' ' || l.token),
vc AS (SELECT DISTINCT token FROM clicks WHERE doc % 2 = 0)
SELECT CASE WHEN s.oracle THEN 'onBeam' WHEN v.token IS NOT NULL THEN 'offBeam' ELSE 'oov' END AS state, count(*) AS n FROM st s LEFT JOIN vc v ON v.token = s.truth GROUP BY 1""")
def off_beam_vs_oov(spark, sf_dir):
    t = clicks(spark, sf_dir)
    rows = K.context_rows(t).withColumn("ngram", F.when(F.col("p2").isNotNull(), F.concat_ws(" ", "p2", "p1", "truth")))
    known = counted(t, 3).filter("n = 3 AND c > 5").select("corpus", "ngram", F.lit(True).alias("hit"))
    beam = rows.join(known, ["corpus", "ngram"], "left").withColumn("oracle", F.coalesce("hit", F.lit(False)))
    return K.unreached(beam, t.filter("doc % 2 = 0")).select("state", "n")
