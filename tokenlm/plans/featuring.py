"""Queries over Kneser-Ney features of held-out tokens: benchmark texts under the statistics of all English documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenlm.operators import counts as C
from tokenlm.operators import features as G
from tokenlm.operators import kn_features as N
from tokenlm.operators import kneser_ney, rewriting
from tokenlm.operators.tokens import PATTERN, lex
from tokenlm.plans.corpora import STATS, WORDS, counted, counted_words, grams_sql, read, words
from tokenlm.plans.counting import COMMON_SQL, RARE_SQL, RECENCY_SQL, TRI, _common
from tokenlm.sources.shared import written

QUERIES, SQL = {}, {}
ORDER = 3
KEYS = ["doc", "pos"]


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


BENCH = f"""bench AS (SELECT 'en' AS corpus, item_id AS doc, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token FROM (SELECT item_id, regexp_extract_all(text, '{PATTERN}') AS t FROM benchmark))"""


def bench(spark, sf_dir, before=ORDER - 1):
    return lex(read(spark, sf_dir, "benchmark").select(F.lit("en").alias("corpus"), F.col("item_id").alias("doc"), "text"), before=before)


def held_out(tokens):
    """corpus, doc, pos and the longest n-gram that ends at each position."""
    return tokens.select("corpus", *KEYS, F.concat_ws(" ", *[f"p{k}" for k in range(ORDER - 1, 0, -1)], "token").alias("ngram"))


def longest_sql(source: str, columns: str = "") -> str:
    """CTE rows_: the longest n-gram at each position of a token table."""
    return f"rows_ AS (SELECT corpus, doc, pos, concat_ws(' ', lag(token, 2) OVER w, lag(token, 1) OVER w, token) AS ngram{columns} FROM {source} WINDOW w AS (PARTITION BY corpus, doc ORDER BY pos))"


def looked_sql(order: int = ORDER) -> str:
    """CTE looked: counts of all suffixes beside each row of rows_, and p, the interpolated probability."""
    levels = range(1, order + 1)
    g = lambda n: f"CASE WHEN k >= {n} THEN array_to_string(t[k - {n - 1}:k], ' ') END AS g{n}, CASE WHEN k >= {n} THEN {'array_to_string(t[k - ' + str(n - 1) + ':k - 1], ' + repr(' ') + ')' if n > 1 else repr('')} END AS h{n}"
    fields = ", ".join(f"coalesce(a{n}.c, 0)::DOUBLE AS c{n}, coalesce(b{n}.kn, 0)::DOUBLE AS kn{n}, coalesce(x{n}.total, 0)::DOUBLE AS total{n}, coalesce(x{n}.followers, 0)::DOUBLE AS followers{n}, coalesce(y{n}.kn_total, 0)::DOUBLE AS kn_total{n}, coalesce(d{n}.discount, 0) AS d{n}" for n in levels)
    joins = " ".join(f"LEFT JOIN cnt a{n} ON a{n}.corpus = r.corpus AND a{n}.n = {n} AND a{n}.ngram = r.g{n} LEFT JOIN kns b{n} ON b{n}.corpus = r.corpus AND b{n}.n = {n} AND b{n}.ngram = r.g{n} LEFT JOIN ctxs x{n} ON x{n}.corpus = r.corpus AND x{n}.n = {n} AND x{n}.ctx = r.h{n} LEFT JOIN knt y{n} ON y{n}.corpus = r.corpus AND y{n}.n = {n} AND y{n}.ctx = r.h{n} LEFT JOIN disc d{n} ON d{n}.corpus = r.corpus AND d{n}.n = {n} AND d{n}.kind = '{'raw' if n == order else 'kn'}'" for n in levels)
    out = f"parts AS (SELECT *, {', '.join(g(n) for n in levels)} FROM (SELECT *, string_split(ngram, ' ') AS t, len(string_split(ngram, ' ')) AS k FROM rows_)),\npr0 AS (SELECT r.*, v.v, {fields}, 1::DOUBLE / v.v AS p0 FROM parts r JOIN voc v ON v.corpus = r.corpus {joins})"
    for n in levels:
        x, total = (f"c{n}", f"total{n}") if n == order else (f"kn{n}", f"kn_total{n}")
        out += f",\npr{n} AS (SELECT *, {x} AS x{n}, {total} AS t{n}, CASE WHEN k >= {n} AND {total} > 0 THEN (greatest({x} - d{n}, 0) + d{n} * followers{n} * p{n - 1}) / {total} ELSE p{n - 1} END AS p{n} FROM pr{n - 1})"
    return out + f",\nlooked AS (SELECT *, p{order} AS p FROM pr{order})"


def features_sql(features: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc, pos, {name} AS fname, round({value}, 9) AS fval FROM looked WHERE {there}" for there, name, value in features)


HELD = f"{TRI},\n{BENCH},\n{longest_sql('bench')},\n{looked_sql()}"


def _looked(spark, sf_dir):
    """Counts of all English documents, the corpus of the held-out texts; totals only of the contexts that occur in these."""
    rows = held_out(bench(spark, sf_dir))
    english = words(spark, sf_dir, ORDER - 1).filter("corpus = 'en'")
    every = written(C.continuations(C.ngram_counts(C.grams(english, ORDER))), "continued")
    return N.looked_up(rows, kneser_ney.totalled(every, N.contexts(rows, ORDER)), ORDER, every)


def _long(rows, features):
    return N.long(rows, KEYS, features).withColumn("fval", F.round("fval", 9))


@query("feature_ngram_kn", f"{HELD} SELECT doc, pos, 'logProb' AS fname, round(ln(p), 6) AS fval FROM looked")
def feature_ngram_kn(spark, sf_dir):
    return _looked(spark, sf_dir).select(*KEYS, F.lit("logProb").alias("fname"), F.round(F.log(N.probability(ORDER)), 6).alias("fval"))


def _indicated_sql(name, x, there):
    return there, f"CASE WHEN {x} <= 2 THEN '{name}=' || CAST({x} AS BIGINT) ELSE '{name}.log' END", f"CASE WHEN {x} <= 2 THEN 1::DOUBLE ELSE ln({x}) END"


COUNTS_SQL = [f for n in (3, 2, 1) for f in (_indicated_sql(f"count{n}", f"c{n}", f"k >= {n}"), _indicated_sql(f"diversityCount{n}", f"kn{n}", f"k > {n}"))]


@query("feature_counts", f"{HELD} {features_sql(COUNTS_SQL)}")
def feature_counts(spark, sf_dir):
    return _long(_looked(spark, sf_dir), N.count_features(ORDER))


def _seen_sql():
    out, live = [], []
    for n in (3, 2, 1):
        there = " AND ".join([f"k >= {n}", *live])
        parts = [(f"count{n}", f"c{n}", there), (f"knCount{n}", f"kn{n}", there)] + ([(f"distinctCount{n}", f"followers{n + 1}", f"{there} AND k > {n}")] if n < 3 else [])
        for name, x, ok in parts:
            out += [(ok, f"CASE WHEN {x} <= 2 THEN '{name}=' || CAST({x} AS BIGINT) ELSE '{name}>=3' END", "1::DOUBLE"), (ok, f"'{name}.log'", f"ln({x} + 1)")]
        live.append(f"(k < {n} OR c{n} = 0)")
    return out


@query("feature_num_seen", f"{HELD} {features_sql(_seen_sql())}")
def feature_num_seen(spark, sf_dir):
    return _long(_looked(spark, sf_dir), N.seen_features(ORDER))


def _start(name, above):
    """The first level whose context has been seen, below the levels in above."""
    return f"'{name},start=' || (k" + "".join(f" - CASE WHEN k >= {m} AND NOT t{m} > 0 THEN 1 ELSE 0 END" for m in above) + ")"


def _interpolation_sql():
    out, factor = [], "1::DOUBLE"
    for n in (3, 2, 1):
        seen, above = f"k >= {n} AND t{n} > 0", range(n + 1, 4)
        out += [(seen, _start(f"prob{n}", above), f"{factor} * x{n} / t{n}"), (f"{seen} AND x{n} >= 1", _start(f"discount{n}>=1.0", above), f"{factor} / t{n}")]
        factor += f" * CASE WHEN {seen} THEN followers{n} / t{n} ELSE 1 END"
    return out


@query("feature_kn_parts", f"{HELD} {features_sql(_interpolation_sql())}")
def feature_kn_parts(spark, sf_dir):
    return _long(_looked(spark, sf_dir), N.interpolation_parts(ORDER))


def _backoff_sql():
    out, live = [], []
    for n in (3, 2, 1):
        above = range(n + 1, 4)
        seen = " AND ".join([f"k >= {n} AND t{n} > 0", *live])
        out += [(f"{seen} AND x{n} > 0", _start(name, above), value) for name, value in ((f"indicator{n}", "1::DOUBLE"), (f"count{n}", f"ln(CASE WHEN x{n} > 0 THEN x{n} - d{n} ELSE 1 END)"), (f"total{n}", f"ln(CASE WHEN t{n} > 0 THEN t{n} ELSE 1 END)"))]
        out += [(f"{seen} AND NOT x{n} > 0", _start(name, above), value) for name, value in ((f"distinct{n}", f"ln(CASE WHEN followers{n} > 0 THEN followers{n} ELSE 1 END)"), (f"distinctTotal{n}", f"ln(CASE WHEN t{n} > 0 THEN t{n} ELSE 1 END)"))]
        live.append(f"NOT (k >= {n} AND t{n} > 0 AND x{n} > 0)")
    return out


@query("feature_backoff_parts", f"{HELD} {features_sql(_backoff_sql())}")
def feature_backoff_parts(spark, sf_dir):
    return _long(_looked(spark, sf_dir), N.backoff_parts(ORDER))


# --- features over rewritten n-grams ---


def _rewritten(rows, stats):
    """ln p of each row's n-gram under statistics over rewritten ones, named by the nearest rare token of the context."""
    name = F.concat(F.lit("logProb,lastRare="), F.col("last_rare").cast("string"))
    return N.looked_up(rows, stats, ORDER).select(*KEYS, name.alias("fname"), F.round(F.log(N.probability(ORDER)), 6).alias("fval"))


def _marked_sql(source, rare):
    """CTE over a token table: tokens, the two before each, and which of them are rare."""
    return f"SELECT corpus, doc, pos, t0, r0, t1, r1, t2, r2 FROM (SELECT w.corpus, w.doc, w.pos, w.token AS t0, {rare} AS r0, lag(w.token, 1) OVER q AS t1, lag({rare}, 1) OVER q AS r1, lag(w.token, 2) OVER q AS t2, lag({rare}, 2) OVER q AS r2 FROM {source} w LEFT JOIN frequent k ON k.token = w.token WINDOW q AS (PARTITION BY w.corpus, w.doc ORDER BY w.pos))"


PATTERN_SQL = """concat_ws(' ', CASE WHEN t2 IS NULL THEN NULL WHEN NOT r2 THEN t2 WHEN r1 AND t1 <> t2 THEN '<1>' ELSE '<0>' END, CASE WHEN t1 IS NULL THEN NULL WHEN r1 THEN '<0>' ELSE t1 END,
  CASE WHEN NOT r0 THEN t0 WHEN t1 IS NOT NULL AND r1 AND t0 = t1 THEN '<0>' WHEN t2 IS NOT NULL AND r2 AND t0 = t2 THEN (CASE WHEN r1 THEN '<1>' ELSE '<0>' END) ELSE '<rare>' END)"""
LAST_RARE = "CASE WHEN t1 IS NOT NULL AND r1 THEN 1 WHEN t2 IS NOT NULL AND r2 THEN 2 ELSE -1 END AS last_rare"
#: Gram rows of the suffixes of full n-grams (full_: corpus, doc, pos, ngram).
SUFFIXES = "grams2 AS (SELECT corpus, doc, pos, n, array_to_string(t[len(t) - n + 1:], ' ') AS ngram, CASE WHEN n > 1 THEN array_to_string(t[len(t) - n + 1:len(t) - 1], ' ') ELSE '' END AS ctx, CASE WHEN n > 1 THEN array_to_string(t[len(t) - n + 2:], ' ') ELSE '' END AS back, n = len(t) AS whole FROM (SELECT corpus, doc, pos, string_split(ngram, ' ') AS t FROM full_) CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE n <= len(t))"
REWRITTEN_STATS = STATS.replace("FROM grams ", "FROM grams2 ").replace("cnt AS", "cnt AS MATERIALIZED", 1)
#: Frequent English tokens: those whose continuation total as a context is 6 or more in the plain statistics.
FREQUENT = f"""WITH {WORDS},
{grams_sql("words", 3)},
plain AS (SELECT n, ngram, ctx, back, sum(CASE WHEN whole THEN 1 ELSE 0 END) AS w FROM grams WHERE corpus = 'en' GROUP BY n, ngram, ctx, back),
before_ AS (SELECT n - 1 AS n, back AS ngram, count(*) AS kd FROM plain WHERE n > 1 GROUP BY n - 1, back),
frequent AS MATERIALIZED (SELECT a.ctx AS token FROM plain a LEFT JOIN before_ p ON p.n = a.n AND p.ngram = a.ngram WHERE a.n = 2 GROUP BY a.ctx HAVING sum(coalesce(p.kd, 0) + a.w) >= 6),
english AS (SELECT * FROM words WHERE corpus = 'en')"""


@query("feature_pattern_kn", f"""{FREQUENT},
{BENCH},
full_ AS (SELECT corpus, doc, pos, {PATTERN_SQL} AS ngram FROM ({_marked_sql("english", "k.token IS NULL")})),
{SUFFIXES},
{REWRITTEN_STATS},
rows_ AS (SELECT corpus, doc, pos, {PATTERN_SQL} AS ngram, {LAST_RARE} FROM ({_marked_sql("bench", "k.token IS NULL")})),
{looked_sql()} SELECT doc, pos, 'logProb,lastRare=' || last_rare AS fname, round(ln(p), 6) AS fval FROM looked""")
def feature_pattern_kn(spark, sf_dir):
    english = words(spark, sf_dir, ORDER - 1).filter("corpus = 'en'")
    common = written(rewriting.common_online(C.continuation_totals(C.continuations(counted(english, ORDER)))), "common")
    full = rewriting.pattern_rows(rewriting.flagged(english, common, ORDER), ORDER)
    stats = kneser_ney.statistics(C.ngram_counts(rewriting.suffix_grams(full, ORDER)))
    return _rewritten(rewriting.pattern_rows(rewriting.flagged(bench(spark, sf_dir), common, ORDER), ORDER), stats)


COMMON_MARK = "CASE WHEN k.token IS NULL THEN '<rare>' ELSE w.token END AS token"


@query("feature_common_kn", f"""WITH {WORDS},
{COMMON_SQL},
{BENCH},
english AS (SELECT w.corpus, w.doc, w.pos, {COMMON_MARK} FROM words w LEFT JOIN common k ON k.token = w.token WHERE w.corpus = 'en'),
{grams_sql("english", 3)},
{STATS},
marked AS (SELECT w.corpus, w.doc, w.pos, {COMMON_MARK} FROM bench w LEFT JOIN common k ON k.token = w.token),
lagged_ AS (SELECT *, lag(token, 1) OVER q AS t1, lag(token, 2) OVER q AS t2 FROM marked WINDOW q AS (PARTITION BY corpus, doc ORDER BY pos)),
rows_ AS (SELECT corpus, doc, pos, concat_ws(' ', t2, t1, token) AS ngram, CASE WHEN t1 = '<rare>' THEN 1 WHEN t2 = '<rare>' THEN 2 ELSE -1 END AS last_rare FROM lagged_),
{looked_sql()} SELECT doc, pos, 'logProb,lastRare=' || last_rare AS fname, round(ln(p), 6) AS fval FROM looked""")
def feature_common_kn(spark, sf_dir):
    every = words(spark, sf_dir, ORDER - 1)
    common = written(_common(every), "common")
    names = ["token", *[f"p{k}" for k in range(1, ORDER)]]
    by_corpus = common.select(F.lit("en").alias("corpus"), "token")

    def marked(tokens):
        flags = rewriting.flagged(tokens, by_corpus, ORDER)
        return flags.withColumns({t: F.when(F.col(t).isNull(), None).when(F.col(f"r{i}"), rewriting.RARE).otherwise(F.col(t)) for i, t in enumerate(names)})

    stats = kneser_ney.statistics(counted(marked(every.filter("corpus = 'en'")).select("corpus", *KEYS, *names), ORDER))
    own = marked(bench(spark, sf_dir))
    ngram = F.concat_ws(" ", *[f"p{k}" for k in range(ORDER - 1, 0, -1)], "token").alias("ngram")
    return _rewritten(own.select("corpus", *KEYS, ngram, rewriting.last_rare(ORDER).alias("last_rare")), stats)


NAMED = """named AS (SELECT 'part' AS corpus, p_partkey AS doc, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS word, t[1] AS name FROM (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)),
renamed AS (SELECT corpus, doc, pos, CASE WHEN word = name THEN '<fileName>' ELSE word END AS token FROM named)"""


@query("feature_filename_kn", f"""WITH {NAMED},
{grams_sql("renamed", 3)},
{STATS},
ctx_ AS (SELECT corpus, doc, pos, token, concat_ws(' ', lag(token, 2) OVER w, lag(token, 1) OVER w) AS before_ FROM renamed WINDOW w AS (PARTITION BY corpus, doc ORDER BY pos)),
rows_ AS (SELECT corpus, doc, pos, kind, trim(before_ || ' ' || CASE WHEN kind = 'own' THEN token ELSE '<fileName>' END) AS ngram FROM ctx_ CROSS JOIN (SELECT unnest(['own', 'name']) AS kind)),
{looked_sql()},
sure AS (SELECT doc, pos FROM looked WHERE kind = 'name' AND p > 0.5)
SELECT l.doc, l.pos, 'logProb' AS fname, round(ln(l.p), 6) AS fval FROM looked l JOIN sure s ON s.doc = l.doc AND s.pos = l.pos WHERE l.kind = 'own'""")
def feature_filename_kn(spark, sf_dir):
    """The first word of a part's name stands for its file's name; positions count where that name is likelier than not."""
    from pyspark.sql.window import Window

    t = F.split("p_name", " ")
    rows = read(spark, sf_dir, "part").select(F.lit("part").alias("corpus"), F.col("p_partkey").alias("doc"), F.posexplode(t).alias("at", "token"), t[0].alias("name"))
    w = Window.partitionBy("corpus", "doc").orderBy("pos")
    tokens = rewriting.rewrite_file_name(rows).select("corpus", "doc", (F.col("at") + 1).cast("long").alias("pos"), "token")
    tokens = tokens.withColumns({f"p{k}": F.lag("token", k).over(w) for k in range(1, ORDER)})
    stats = kneser_ney.statistics(counted(tokens, ORDER))
    before = [f"p{k}" for k in range(ORDER - 1, 0, -1)]
    both = N.looked_up(tokens.select("corpus", *KEYS, F.concat_ws(" ", *before, "token").alias("ngram"), F.concat_ws(" ", *before, F.lit(rewriting.FILE_NAME)).alias("other")), stats, ORDER)
    own = both.select("corpus", *KEYS, "other", N.probability(ORDER).alias("p_own"))
    sure = N.looked_up(own.withColumnRenamed("other", "ngram"), stats, ORDER).filter(N.probability(ORDER) > 0.5)
    return sure.select(*KEYS, F.lit("logProb").alias("fname"), F.round(F.log("p_own"), 6).alias("fval"))


@query("file_continuations", f"""WITH {WORDS}, grams AS (SELECT corpus, doc, pos, 1 AS n, token AS ngram, '' AS ctx, '' AS back, FALSE AS whole FROM words
  UNION ALL SELECT corpus, doc, pos, 2, doc || ' ' || token, CAST(doc AS VARCHAR), token, TRUE FROM words),
{STATS} SELECT corpus, ngram AS token, CAST(kn AS BIGINT) AS files FROM kns WHERE n = 1""")
def file_continuations(spark, sf_dir):
    """Statistics over pairs of document and token: a token's continuation count is the number of documents that have it."""
    w = words(spark, sf_dir)
    cell = lambda n, ngram, whole: F.struct(F.lit(n).alias("n"), ngram.alias("ngram"), F.lit(whole).alias("whole"))
    rows = w.select("corpus", "doc", "pos", F.explode(F.array(cell(1, F.col("token"), False), cell(2, F.concat_ws(" ", F.col("doc").cast("string"), "token"), True))).alias("g")).select("corpus", "doc", "pos", "g.*")
    return C.continuations(C.ngram_counts(rows)).filter("n = 1").select("corpus", F.col("ngram").alias("token"), F.col("kn").alias("files"))


@query("recency_rare", f"""{RECENCY_SQL.replace(f"WITH {WORDS}", TRI)},
{RARE_SQL},
marked AS (SELECT r.corpus, r.flag, CASE WHEN k.token IS NULL THEN r.token ELSE '<rare>' END AS token FROM rec r LEFT JOIN rare k ON k.corpus = r.corpus AND k.token = r.token WHERE r.flag IS NOT NULL)
SELECT corpus, fname, count(*) AS n FROM (SELECT corpus, flag AS fname FROM marked UNION ALL SELECT corpus, '''' || token || ''',' || flag FROM marked) GROUP BY corpus, fname""")
def recency_rare(spark, sf_dir):
    """How often each recency feature is there: the flag alone, and with the token, rare ones as one."""
    counts = counted_words(spark, sf_dir, ORDER)
    common = written(rewriting.common_online(C.continuation_totals(C.continuations(counts))), "common")
    return G.recency_with_token(words(spark, sf_dir), common).groupBy("corpus", "fname").agg(F.count("*").alias("n"))
