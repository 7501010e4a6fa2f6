"""Queries over splits, scalars, mixers, learning, lexing, search and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.functions import scalars as S
from tokenlm.operators import candidates as K
from tokenlm.operators import counts as C
from tokenlm.operators import features as G
from tokenlm.operators import contexts, latent, learning, lexer, mixing, prequential, search, splits
from tokenlm.operators.tokens import PATTERN
from tokenlm.plans.corpora import CLICKS, WORDS, clicks, counted, read, words
from tokenlm.plans.counting import CAND, WEIGHTS, ranked, states, values
from tokenlm.sources import synthetic
from tokenlm.sources.shared import written

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")


@query("docs_per_lang", f"WITH {WORDS} SELECT d.lang, count(*) AS docs, CAST(sum(coalesce(w.n, 0)) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN (SELECT doc, count(*) AS n FROM words GROUP BY doc) w ON w.doc = d.doc_id GROUP BY d.lang HAVING count(*) >= 5")
def docs_per_lang(spark, sf_dir):
    n = words(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"))
    docs = _docs(spark, sf_dir)
    return docs.join(splits.supported(docs).select("lang"), "lang", "left_semi").join(n, "doc", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_tokens"))


IDX = "idx AS (SELECT doc_id AS doc, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)"


@query("range_flags", f"WITH {IDX} SELECT doc, lang, idx, idx >= 0 AND idx < floor(0.5::DOUBLE * n) AS is_count, idx >= floor(0.5::DOUBLE * n) AND idx < floor(-0.2::DOUBLE * n) + n AS is_tune, idx >= floor(-0.2::DOUBLE * n) + n AND idx < floor(1::DOUBLE * n) AS is_eval, idx >= 3 AND idx < 10 AS is_web FROM idx")
def range_flags(spark, sf_dir):
    return splits.range_flags(_docs(spark, sf_dir), {"is_count": (0, 0.5), "is_tune": (0.5, -0.2), "is_eval": (-0.2, 1), "is_web": (3, 10)})


@query("doc_split_flags", """WITH s AS (SELECT doc_id AS doc, lang, count(*) OVER (PARTITION BY lang) AS docs, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS place FROM documents)
SELECT doc, lang, place <= floor(round(0.2::DOUBLE * docs, 9)) + 1 AS is_tune, TRUE AS is_count, place = floor(round(0.2::DOUBLE * docs, 9)) + 2 AS is_last_count FROM s WHERE docs >= 5""")
def doc_split_flags(spark, sf_dir):
    return splits.split_flags(_docs(spark, sf_dir), 0.8).select("doc", "lang", "is_tune", "is_count", "is_last_count")


@query("tuning_period", f"""WITH {WORDS}, n AS (SELECT corpus AS lang, doc, count(*) AS n_tokens FROM words GROUP BY corpus, doc), t AS (SELECT lang, count(*) AS tuned FROM n GROUP BY lang)
SELECT n.lang, n.doc, n.n_tokens, CAST(greatest(1, floor(n.n_tokens / greatest(floor(2000 / t.tuned), 1))) AS BIGINT) AS period FROM n JOIN t ON t.lang = n.lang""")
def tuning_period(spark, sf_dir):
    n = words(spark, sf_dir).groupBy(F.col("corpus").alias("lang"), "doc").agg(F.count("*").alias("n_tokens"))
    return splits.tuning_period(n, 2000)


@query("systematic_sample", f"WITH {IDX} SELECT doc, lang, idx FROM idx WHERE idx % 7 = 0")
def systematic_sample(spark, sf_dir):
    return splits.systematic(_docs(spark, sf_dir), 7)


@query("permuted_docs", "SELECT doc_id AS doc, lang, md5('1:' || doc_id) AS shuffle_key FROM documents")
def permuted_docs(spark, sf_dir):
    return splits.permuted(_docs(spark, sf_dir), 1)


@query("token_phases", f"""WITH {WORDS}, n AS (SELECT doc, count(*) AS n_tokens FROM words GROUP BY doc), b AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM n)
SELECT doc, n_tokens, before, CASE WHEN before < 50000 THEN 'train' WHEN before < 60000 THEN 'tune' WHEN before < 90000 THEN 'test' ELSE 'none' END AS phase FROM b""")
def token_phases(spark, sf_dir):
    return splits.phases(words(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n_tokens")), 50_000, 10_000, 30_000)


@query("word_shape", f"WITH {WORDS} SELECT regexp_replace(regexp_replace(regexp_replace(token, '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '0', 'g') AS shape, count(*) AS c FROM words GROUP BY 1")
def word_shape(spark, sf_dir):
    return words(spark, sf_dir).groupBy(S.word_shape(F.col("token")).alias("shape")).agg(F.count("*").alias("c"))


@query("path_parts", "WITH p AS (SELECT page_id, url FROM pages) SELECT page_id, regexp_extract(url, '[^/]\\.([^./]*)$', 1) AS extension, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^([^.]*)', 1) AS base_name FROM p")
def path_parts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.extension(F.col("url")).alias("extension"), S.base_name(F.col("url")).alias("base_name"))


@query("dir_depth", "SELECT page_id, CAST(len(string_split(url, '/')) - 1 AS BIGINT) AS depth FROM pages")
def dir_depth(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.directory_depth(F.col("url")).alias("depth"))


# --- mixers over the last one and two event types ---

FEATS = ["prev", "prev_two"]
MIX = f"""WITH {CLICKS},
cx AS (SELECT doc, pos, token, coalesce(lag(token, 1) OVER w, '') AS prev, coalesce(lag(token, 2) OVER w, '') || ' ' || coalesce(lag(token, 1) OVER w, '') AS prev_two FROM clicks WINDOW w AS (PARTITION BY doc ORDER BY pos)),
lng AS (SELECT doc, pos, token, 'prev' AS feature, prev AS value FROM cx UNION ALL SELECT doc, pos, token, 'prev_two', prev_two FROM cx),
fc AS (SELECT feature, value, token, count(*) AS count FROM lng GROUP BY feature, value, token),
ft AS (SELECT feature, value, sum(count) AS total FROM fc GROUP BY feature, value),
rw AS (SELECT l.doc, l.pos, l.token, l.feature, f.count, t.total FROM lng l JOIN fc f ON f.feature = l.feature AND f.value = l.value AND f.token = l.token JOIN ft t ON t.feature = l.feature AND t.value = l.value)"""


def _mix(spark, sf_dir):
    cx = G.context_columns(clicks(spark, sf_dir))
    fc = mixing.feature_counts(cx, FEATS)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATS]))
    long = cx.select("doc", "pos", "token", cells.alias("x")).select("doc", "pos", "token", "x.*")
    return fc, long.join(fc, ["feature", "value", "token"])


@query("product_of_experts", f"{MIX} SELECT doc, pos, round(sum(ln(count::DOUBLE / total)), 6) AS score FROM rw GROUP BY doc, pos")
def product_of_experts(spark, sf_dir):
    return mixing.product_of_experts(_mix(spark, sf_dir)[1], ["doc", "pos"]).withColumn("score", F.round("score", 6))


@query("bucket_weights", f"{MIX} SELECT doc, pos, round(sum((CASE WHEN feature = 'prev' THEN 1::DOUBLE ELSE 2::DOUBLE END) * (floor(log10(total)) + 1) * ln(count::DOUBLE / total)), 6) AS score FROM rw GROUP BY doc, pos")
def bucket_weights(spark, sf_dir):
    w = spark.createDataFrame([(f, b, float((k + 1) * (b + 1))) for k, f in enumerate(FEATS) for b in range(19)], "feature string, bucket long, weight double")
    return mixing.weighted_product(_mix(spark, sf_dir)[1], F.broadcast(w), ["doc", "pos"]).withColumn("score", F.round("score", 6))


@query("naive_bayes_score", f"""{MIX}, tn AS (SELECT token, count(*) AS n FROM clicks GROUP BY token), al AS (SELECT sum(n) AS all_n, count(*) AS v FROM tn)
SELECT f.feature, f.value, f.token, round(ln((t.n + 1)::DOUBLE / (a.all_n + a.v)) + ln((f.count + 5e-5::DOUBLE) / (t.n + 1)), 6) AS score FROM fc f JOIN tn t ON t.token = f.token CROSS JOIN al a""")
def naive_bayes_score(spark, sf_dir):
    n = clicks(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return mixing.naive_bayes(_mix(spark, sf_dir)[0], n).withColumn("score", F.round("score", 6))


@query("multiplicative_weights", f"""{MIX}, s AS (SELECT *, coalesce(sum(ln(count::DOUBLE / total)) OVER (PARTITION BY doc, feature ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM rw),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc, pos)) AS e FROM s) SELECT doc, pos, feature, round(e / sum(e) OVER (PARTITION BY doc, pos), 6) AS weight FROM e""")
def multiplicative_weights(spark, sf_dir):
    return mixing.multiplicative_weights(_mix(spark, sf_dir)[1], "pos").select("doc", "pos", "feature", F.round("weight", 6).alias("weight"))


@query("bma_weights", f"""{MIX}, v AS (SELECT count(DISTINCT token) AS v FROM fc), c AS (SELECT feature, value, sum(lgamma(count + 1::DOUBLE)) AS f, sum(count) AS total FROM fc GROUP BY feature, value),
m AS (SELECT feature, sum(f + lgamma(v::DOUBLE) - lgamma((total + v)::DOUBLE)) AS m FROM c CROSS JOIN v GROUP BY feature), e AS (SELECT *, exp(m - max(m) OVER ()) AS e FROM m)
SELECT feature, round(m, 4) AS log_marginal, round(e / sum(e) OVER (), 6) AS weight FROM e""")
def bma_weights(spark, sf_dir):
    return mixing.model_average(_mix(spark, sf_dir)[0]).select("feature", F.round("log_marginal", 4).alias("log_marginal"), F.round("weight", 6).alias("weight"))


LATTICE = f"""WITH {CLICKS}, ev AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, user_id AS doc, event_type AS token, date_part('hour', ts) AS h FROM events),
cx AS (SELECT e.doc, e.pos, e.token, coalesce(lag(e.token, 1) OVER (PARTITION BY e.doc ORDER BY e.pos), '') AS prev, CAST(CAST(h AS BIGINT) AS VARCHAR) AS hour FROM ev e),
lc AS (SELECT node, value, token, count(*) AS count FROM (SELECT 'prev/hour' AS node, prev || '|' || hour AS value, token FROM cx UNION ALL SELECT 'prev/*', prev || '|', token FROM cx UNION ALL SELECT '*/hour', '|' || hour, token FROM cx UNION ALL SELECT '*/*', '|', token FROM cx) GROUP BY node, value, token)"""


def _lattice(spark, sf_dir):
    w = Window.partitionBy("doc").orderBy("pos")
    hour = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"), F.col("event_type").alias("token"), F.hour("ts").cast("string").alias("hour"))
    return hour.withColumn("prev", F.coalesce(F.lag("token", 1).over(w), F.lit("")))


@query("feature_lattice_counts", f"{LATTICE} SELECT node, value, token, count FROM lc")
def feature_lattice_counts(spark, sf_dir):
    return mixing.lattice_counts(_lattice(spark, sf_dir), [["prev"], ["hour"]])


@query("grid_kn_prob", f"""{LATTICE}, st AS (SELECT node, value, sum(count) AS t, count(*) AS f FROM lc GROUP BY node, value), v AS (SELECT count(DISTINCT token) AS v FROM lc),
n0 AS (SELECT x.doc, x.pos, x.prev, x.hour, x.token, (greatest(c.count - 0.5::DOUBLE, 0) + 0.5::DOUBLE * s.f / v.v) AS num, s.t AS den FROM cx x JOIN lc c ON c.node = '*/*' AND c.token = x.token JOIN st s ON s.node = '*/*' CROSS JOIN v),
n1 AS (SELECT a.*, (greatest(c.count - 0.5::DOUBLE, 0) + 0.5::DOUBLE * s.f * a.num / a.den) AS num1, s.t AS den1 FROM n0 a JOIN lc c ON c.node = '*/hour' AND c.value = '|' || a.hour AND c.token = a.token JOIN st s ON s.node = '*/hour' AND s.value = '|' || a.hour),
n2 AS (SELECT a.*, (greatest(c.count - 0.5::DOUBLE, 0) + 0.5::DOUBLE * s.f * a.num / a.den) AS num2, s.t AS den2 FROM n1 a JOIN lc c ON c.node = 'prev/*' AND c.value = a.prev || '|' AND c.token = a.token JOIN st s ON s.node = 'prev/*' AND s.value = a.prev || '|')
SELECT a.doc, a.pos, round((greatest(c.count - 0.5::DOUBLE, 0) + 0.5::DOUBLE * s.f * ((a.num1 + a.num2) / (a.den1 + a.den2))) / s.t, 6) AS p FROM n2 a JOIN lc c ON c.node = 'prev/hour' AND c.value = a.prev || '|' || a.hour AND c.token = a.token JOIN st s ON s.node = 'prev/hour' AND s.value = a.prev || '|' || a.hour""")
def grid_kn_prob(spark, sf_dir):
    cx = written(_lattice(spark, sf_dir), "lattice")
    chains = [["prev"], ["hour"]]
    return mixing.lattice_probability(written(mixing.lattice_counts(cx, chains), "nodes"), cx, chains).select("doc", "pos", F.round("p", 6).alias("p"))


# --- learning ---

GRAD = f"""{CAND},
held AS (SELECT r.* FROM ranked r JOIN (SELECT doc, pos FROM ranked WHERE cand = truth) h ON h.doc = r.doc AND h.pos = r.pos),
g AS (SELECT feature, sum(g) / (SELECT count(*) FROM held WHERE cand = truth) AS gradient FROM (SELECT unnest(['c1', 'c2', 'c3']) AS feature, unnest([ln(c1 + 1::DOUBLE), ln(c2 + 1::DOUBLE), ln(c3 + 1::DOUBLE)]) * (CASE WHEN cand = truth THEN 1::DOUBLE ELSE 0 END - prob) AS g FROM held) GROUP BY feature)"""


@query("gradient_one_batch", f"{GRAD} SELECT feature, round(gradient, 6) AS gradient FROM g")
def gradient_one_batch(spark, sf_dir):
    return learning.gradient(ranked(spark, sf_dir), values()).withColumn("gradient", F.round("gradient", 6))


@query("adagrad_one_step", f"{GRAD} SELECT feature, round(CASE feature WHEN 'c1' THEN 0.5::DOUBLE WHEN 'c2' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END + CASE WHEN abs(gradient) < 1e-6 THEN 0 ELSE gradient / sqrt(1 + gradient * gradient) END, 6) AS weight FROM g")
def adagrad_one_step(spark, sf_dir):
    params = spark.createDataFrame([(k, v, 1.0) for k, v in WEIGHTS.items()], "feature string, weight double, sum_sq double")
    return learning.adagrad(params, learning.gradient(ranked(spark, sf_dir), values())).select("feature", F.round("weight", 6).alias("weight"))


@query("sgd_weights")
def sgd_weights(spark, sf_dir):
    """One sequential pass per corpus over all contexts."""
    t = clicks(spark, sf_dir)
    places = prequential.numbered(t).select("corpus", "doc", "pos", "g")
    rows = K.scored(K.staged(t, C.followers(C.grams(t, 3))), t, counted(t, 3)).join(places, ["corpus", "doc", "pos"])
    return learning.sequential(rows.select("corpus", "g", "cand", "truth", *[v.alias(k) for k, v in values().items()]), list(WEIGHTS))


# --- latent clusters: two of them, with weights of their own for the counts after one and two tokens ---

CLUSTERS, CLUSTERED = 2, ["c2", "c3"]
LATENT_WEIGHTS = {"c1": 0.5, "c2,cluster=0": 0.7, "c3,cluster=0": 0.9, "c2,cluster=1": 1.1, "c3,cluster=1": 0.1}
LATENT = f"""{CAND},
two AS (SELECT doc, pos, truth, cand, ln(c1 + 1::DOUBLE) AS v1, ln(c2 + 1::DOUBLE) AS v2, ln(c3 + 1::DOUBLE) AS v3 FROM sc),
zs AS (SELECT *, 0.5::DOUBLE * v1 + 0.7::DOUBLE * v2 + 0.9::DOUBLE * v3 AS s0, 0.5::DOUBLE * v1 + 1.1::DOUBLE * v2 + 0.1::DOUBLE * v3 AS s1 FROM two),
ze AS (SELECT *, exp(s0 - max(greatest(s0, s1)) OVER w) AS e0, exp(s1 - max(greatest(s0, s1)) OVER w) AS e1 FROM zs WINDOW w AS (PARTITION BY doc, pos)),
zp AS (SELECT *, e0 / sum(e0 + e1) OVER w AS q0, e1 / sum(e0 + e1) OVER w AS q1 FROM ze WINDOW w AS (PARTITION BY doc, pos))"""


def _latent(spark, sf_dir):
    t = clicks(spark, sf_dir)
    rows = K.scored(K.staged(t, C.followers(C.grams(t, 3))), t, counted(t, 3))
    return latent.softmax(rows, latent.scores(values(), LATENT_WEIGHTS, CLUSTERED, CLUSTERS))


@query("latent_probabilities", f"{LATENT} SELECT doc, pos, cand, round(q0 + q1, 9) AS prob FROM zp")
def latent_probabilities(spark, sf_dir):
    return _latent(spark, sf_dir).select("doc", "pos", "cand", F.round("prob", 9).alias("prob"))


@query("latent_posterior", f"{LATENT} SELECT doc, pos, unnest([0, 1]) AS cluster, round(unnest([q0, q1]) / (q0 + q1), 9) AS posterior FROM zp WHERE cand = truth")
def latent_posterior(spark, sf_dir):
    return latent.posterior(_latent(spark, sf_dir)).select("doc", "pos", "cluster", F.round("posterior", 9).alias("posterior"))


@query("latent_gradient", f"""{LATENT},
kept AS (SELECT z.*, CASE WHEN z.cand = z.truth THEN 1::DOUBLE ELSE 0 END AS hit FROM zp z JOIN (SELECT doc, pos FROM zp WHERE cand = truth) h ON h.doc = z.doc AND h.pos = z.pos),
parts AS (SELECT unnest(['c1', 'c2,cluster=0', 'c2,cluster=1', 'c3,cluster=0', 'c3,cluster=1']) AS feature,
  unnest([(hit - q0 - q1) * v1, (hit * q0 / (q0 + q1) - q0) * v2, (hit * q1 / (q0 + q1) - q1) * v2, (hit * q0 / (q0 + q1) - q0) * v3, (hit * q1 / (q0 + q1) - q1) * v3]) AS g FROM kept)
SELECT feature, round(sum(g) / (SELECT sum(hit) FROM kept), 6) AS gradient FROM parts GROUP BY feature""")
def latent_gradient(spark, sf_dir):
    g = latent.gradient(_latent(spark, sf_dir), values(), CLUSTERED, CLUSTERS)
    return g.select("feature", F.round("gradient", 6).alias("gradient"))


@query("feature_differences", f"""{CAND},
parts AS (SELECT doc, pos, cand, truth, rank, unnest(['c1', 'c2', 'c3']) AS feature, unnest([0.5::DOUBLE * ln(c1 + 1::DOUBLE), 0.7::DOUBLE * ln(c2 + 1::DOUBLE), 0.9::DOUBLE * ln(c3 + 1::DOUBLE)]) AS part FROM ranked),
diffs AS (SELECT doc, pos, feature, sum(part * (CASE WHEN cand = truth THEN 1 ELSE 0 END - CASE WHEN rank = 0 THEN 1 ELSE 0 END)) AS d FROM parts WHERE (cand = truth OR rank = 0) AND part <> 0 GROUP BY doc, pos, feature)
SELECT doc, pos, feature, round(d, 6) AS difference FROM diffs WHERE abs(d) > 1e-12""")
def feature_differences(spark, sf_dir):
    """What each feature adds to the true token's score less what it adds to the best candidate's."""
    return latent.differences_of_all(clicks(spark, sf_dir), values(), WEIGHTS).select("doc", "pos", "feature", F.round("difference", 6).alias("difference"))


# --- search, acceptance, lexing, generators, reports ---

PATHS = f"""WITH {CLICKS}, bg AS (SELECT last, token, count(*) AS c FROM (SELECT lag(token, 1) OVER (PARTITION BY doc ORDER BY pos) AS last, token FROM clicks) WHERE last IS NOT NULL GROUP BY last, token),
nx AS (SELECT last, token, c::DOUBLE / sum(c) OVER (PARTITION BY last) AS p FROM bg),
d1 AS (SELECT s.last AS ctx_id, n.token AS path, n.token AS t, n.p AS prob FROM (SELECT DISTINCT last FROM nx) s JOIN nx n ON n.last = s.last WHERE n.p >= 0.02 QUALIFY row_number() OVER (PARTITION BY s.last ORDER BY n.p DESC, n.token) <= 3),
d2 AS (SELECT d.ctx_id, d.path || ' ' || n.token AS path, d.path AS parent, d.prob * n.p AS prob FROM d1 d JOIN nx n ON n.last = d.t WHERE d.prob * n.p >= 0.02 QUALIFY row_number() OVER (PARTITION BY d.ctx_id, d.path ORDER BY d.prob * n.p DESC, n.token) <= 3)
SELECT ctx_id, path, round(prob, 6) AS prob, CAST(1 AS INTEGER) AS length, round(prob - coalesce((SELECT sum(prob) FROM d2 WHERE d2.ctx_id = d1.ctx_id AND d2.parent = d1.path), 0), 6) AS exclusive_prob FROM d1
UNION ALL SELECT ctx_id, path, round(prob, 6), 2, round(prob, 6) FROM d2"""


@query("multi_token_paths", PATHS)
def multi_token_paths(spark, sf_dir):
    following = search.next_tokens(counted(clicks(spark, sf_dir), 2))
    starts = following.select(F.col("last").alias("ctx_id"), "corpus", "last").distinct()
    found = search.paths(starts, following, threshold=0.02, branching=3, depth=2)
    return found.select("ctx_id", "path", F.round("prob", 6).alias("prob"), "length", F.round("exclusive_prob", 6).alias("exclusive_prob"))


EDITS = """names AS (SELECT p_partkey, string_split(p_name, ' ') AS old, p_partkey % 6 AS kind FROM part),
halves AS (SELECT *, CAST(floor(len(old) / 2) AS BIGINT) AS cut FROM names),
edits AS (SELECT p_partkey, old, kind, CASE WHEN kind = 1 THEN cut + 1 ELSE cut END AS cursor, CASE
  WHEN kind IN (0, 1) THEN old[:cut] || ['new', 'words'] || old[cut + 1:] WHEN kind = 2 THEN old[:cut] || ['new', 'other', 'end'] || old[cut + 1:]
  WHEN kind = 3 THEN old[:cut - 1] || ['new', 'words'] || old[cut + 1:] WHEN kind = 4 THEN old[:cut] || old[cut + 2:] ELSE old[:cut] || ['words'] || old[cut + 1:] END AS new FROM halves),
found AS (SELECT *, CASE WHEN len(new) > len(old) AND cursor <= len(old) AND new[:cursor] = old[:cursor] AND new[cursor + 1 + len(new) - len(old):] = old[cursor + 1:]
  THEN new[cursor + 1:cursor + len(new) - len(old)] END AS ins FROM edits)"""


@query("acceptance_match", f"""WITH {EDITS}
SELECT p_partkey, coalesce(array_to_string(ins, ' '), '') AS inserted, CAST(CASE WHEN ins IS NULL THEN -1 WHEN ins[1] <> 'new' THEN 0 WHEN len(ins) < 2 OR ins[2] <> 'other' THEN 1 ELSE 2 END AS BIGINT) AS run FROM found""")
def acceptance_match(spark, sf_dir):
    """Part names are edited: words put in at the cursor, or a place beside it, replaced, or taken out. Only a true insertion
    at the cursor is found again, and matched with a candidate of two words; others have no words and -1."""
    old, kind = F.split("p_name", " "), F.col("p_partkey") % 6
    cut = F.floor(F.size(old) / 2).cast("int")
    words = lambda *some: F.array(*[F.lit(w) for w in some])
    put = lambda left, some, right: F.concat(F.slice(old, F.lit(1), left), some, F.slice(old, right + 1, F.size(old)))
    new = F.when(kind < 2, put(cut, words("new", "words"), cut)).when(kind == 2, put(cut, words("new", "other", "end"), cut)).when(kind == 3, put(cut - 1, words("new", "words"), cut)).when(kind == 4, put(cut, F.array().cast("array<string>"), cut + 1)).otherwise(put(cut, words("words"), cut))
    cursor = F.when(kind == 1, cut + 1).otherwise(cut)
    rows = read(spark, sf_dir, "part").select("p_partkey", old.alias("old"), new.alias("new"), cursor.alias("cursor"))
    found = rows.withColumn("ins", search.insertion(F.col("old"), F.col("new"), F.col("cursor")))
    return found.select("p_partkey", F.coalesce(F.array_join("ins", " "), F.lit("")).alias("inserted"), F.when(F.col("ins").isNotNull(), search.common_run(F.col("ins"), words("new", "other"))).otherwise(-1).cast("long").alias("run"))


# --- contexts ---


@query("line_contexts", f"""WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
parts AS (SELECT doc_id, k, line, unnest(generate_series(1, len(t))) AS i, unnest(t) AS token FROM (SELECT *, regexp_extract_all(line, '{PATTERN}|\\s') AS t FROM lines)),
placed AS (SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS loc FROM parts),
ctx AS (SELECT doc_id, substring(line, 1, loc) AS prefix FROM placed WHERE NOT regexp_full_match(token, '\\s'))
SELECT doc_id AS doc, CASE WHEN trim(prefix, ' ') = '' THEN 'true' ELSE 'false' END AS "isLineStart", length(regexp_extract(prefix, '^\\s*')) AS indent, count(*) AS n FROM ctx GROUP BY 1, 2, 3""")
def line_contexts(spark, sf_dir):
    """How many tokens start a line, and how deep their lines are indented."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    rows = contexts.with_contexts(contexts.line_tokens(docs, "doc"), ["isLineStart", "indentLevel"])
    return rows.groupBy("doc", "isLineStart", F.length("indentLevel").cast("long").alias("indent")).agg(F.count("*").alias("n"))


@query("identifier_recency", f"""WITH {WORDS}, own AS (SELECT *, row_number() OVER (PARTITION BY corpus, doc ORDER BY pos) AS number FROM words WHERE regexp_matches(token, '^\\w')),
ago AS (SELECT corpus, number - lag(number) OVER (PARTITION BY corpus, doc, token ORDER BY pos) AS d FROM own)
SELECT corpus, CAST(CASE WHEN d IS NULL THEN -1 ELSE floor(log2(d::DOUBLE) + 1e-12) END AS INTEGER) AS bucket, count(*) AS n FROM ago GROUP BY 1, 2""")
def identifier_recency(spark, sf_dir):
    return contexts.identifier_recency(words(spark, sf_dir)).groupBy("corpus", "bucket").agg(F.count("*").alias("n"))


@query("chain_counts", f"""WITH {WORDS}, lagged AS (SELECT token, coalesce(lag(token, 1) OVER w, '') AS p1, coalesce(lag(token, 2) OVER w, '') AS p2, coalesce(lag(token, 3) OVER w, '') AS p3 FROM words WINDOW w AS (PARTITION BY doc ORDER BY pos)),
long AS (SELECT token, unnest([3, 2, 1, 0]) AS level, unnest([p3 || ' ' || p2 || ' ' || p1, p2 || ' ' || p1, p1, '']) AS ctx, unnest([p2 || ' ' || p1, p1, '', NULL]) AS up FROM lagged),
own AS (SELECT level, ctx, up, token, count(*) AS c FROM long GROUP BY level, ctx, up, token),
above AS (SELECT level - 1 AS level, up AS ctx, token, count(*) AS kn FROM own WHERE level > 0 GROUP BY level, up, token)
SELECT CAST(o.level AS INTEGER) AS level, o.ctx, o.token, o.c, coalesce(a.kn, 0) AS kn FROM own o LEFT JOIN above a ON a.level = o.level AND a.ctx = o.ctx AND a.token = o.token""")
def chain_counts(spark, sf_dir):
    return contexts.ngram_chain_counts(words(spark, sf_dir, 3), 4)


def _lexed(spark, sf_dir):
    return lexer.lexed(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("url").alias("path"), F.col("html").alias("text")))


@query("lexer_states")
def lexer_states(spark, sf_dir):
    return _lexed(spark, sf_dir).groupBy("ttype", "tctx").agg(F.count("*").alias("n"))


@query("indent_tokens")
def indent_tokens(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.col("source"), F.lit(".py")).alias("path"), "text")
    return lexer.lexed(docs).groupBy("ttype").agg(F.count("*").alias("n"))


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


@query("detokenize", f"""WITH {WORDS}, pairs AS (SELECT corpus, doc, pos, token, lag(token) OVER (PARTITION BY corpus, doc ORDER BY pos) AS p FROM words)
SELECT corpus, doc, string_agg(CASE WHEN p IS NULL THEN '' ELSE repeat(' ', CAST(regexp_full_match(p, '\\w+') AND regexp_full_match(token, '\\w+') AS INTEGER) + CAST(p IN ({_in(lexer.BEFORE_BRACKET)}) AND token = '(' AS INTEGER)
  + CAST(p IN ({_in(lexer.SPACE_AFTER)}) AS INTEGER) + CAST(token IN ({_in(lexer.SPACE_BEFORE)}) AS INTEGER)) END || token, '' ORDER BY pos) AS text FROM pairs GROUP BY corpus, doc""")
def detokenize(spark, sf_dir):
    return lexer.joined(words(spark, sf_dir), ["corpus", "doc"])


@query("powerlaw_docs", f"""WITH cells AS (SELECT d AS doc, p AS pos FROM range(200) t(d), range(1, 11) q(p)),
raw AS (SELECT doc, pos, len(list_filter({synthetic.edges(100, 2.0)}, lambda e: e <= CAST('0x' || substr(md5('1:' || doc || ':' || pos), 1, 10) AS BIGINT)::DOUBLE / 1099511627776)) AS i FROM cells)
SELECT a.doc, a.pos, 'w' || CASE WHEN a.pos > 1 AND a.pos % 2 = 1 THEN (b.i - a.i + 100) % 100 ELSE a.i END AS token FROM raw a LEFT JOIN raw b ON b.doc = a.doc AND b.pos = a.pos - 1""")
def powerlaw_docs(spark, sf_dir):
    return synthetic.power_law(spark, 200, bigram=True)


@query("run_comparison_pivot", f"""{CAND} SELECT doc, round(avg(CASE WHEN rank = 0 AND cand = truth THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE cand = truth), 6) AS top1, round(avg(CASE WHEN rank < 2 THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE cand = truth), 6) AS top2 FROM ranked GROUP BY doc""")
def run_comparison_pivot(spark, sf_dir):
    """Accuracy of two runs side by side: one shows a single candidate, the other two."""
    s = states(spark, sf_dir)
    runs = s.select("doc", F.lit("top1").alias("run"), (F.col("rank") < 1).cast("double").alias("hit")).union(s.select("doc", F.lit("top2").alias("run"), (F.col("rank") < 2).cast("double").alias("hit")))
    wide = runs.groupBy("doc").pivot("run", ["top1", "top2"]).agg(F.avg("hit"))
    return wide.select("doc", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"))
