"""Forms of queries that hold on larger inputs give what the plainer forms give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenlm.operators import candidates, contexts, counts, kn_features, kneser_ney, latent
from tokenlm.operators.tokens import lex


def test_statistics_of_some_contexts(spark):
    """Only the contexts asked for are totalled; probabilities stay those of all statistics, of unseen n-grams too."""
    docs = spark.createDataFrame([("c", 1, "a b a b c d e f"), ("c", 2, "a b d . e f g h i j")], "corpus string, doc long, text string")
    every = counts.continuations(counts.ngram_counts(counts.grams(lex(docs, before=2), 3)))
    rows = spark.createDataFrame([("c", "a b c"), ("c", "b z"), ("c", "z a b"), ("c", "a b z"), ("c", "z")], "corpus string, ngram string")
    some, full = kneser_ney.totalled(every, kn_features.contexts(rows, 3)), kneser_ney.totalled(every)
    assert some.filter("n > 1").count() < full.filter("n > 1").count() and some.filter("n = 1").count() == full.filter("n = 1").count()
    shown = lambda t: sorted((r.ngram, round(r.p, 12)) for r in t.select("ngram", kn_features.probability(3).alias("p")).collect())
    assert shown(kn_features.looked_up(rows, some, 3, every)) == shown(kn_features.looked_up(rows, full, 3))


def test_differences_in_one_pass(spark):
    """Without a join, differences are those of all contributions; a truth that is the best candidate has none."""
    rows = [("c", 1, 1, "a", "b", 0, 1.0, 0.0), ("c", 1, 1, "b", "b", 1, 0.5, 2.0), ("c", 1, 1, "d", "b", 2, 0.1, 0.3), ("c", 1, 2, "a", "a", 0, 1.0, 1.0), ("c", 1, 3, "a", "z", 0, 0.0, 3.0)]
    ranked = spark.createDataFrame(rows, "corpus string, doc long, pos long, cand string, truth string, rank int, x double, y double")
    values, weights = {"x": F.col("x"), "y": F.col("y")}, {"x": 0.5, "y": 2.0}
    got, want = latent.differences_of(ranked, values, weights), latent.differences(latent.contributions(ranked, values, weights), ranked)
    shown = lambda t: sorted((r.pos, r.feature, round(r.difference, 9)) for r in t.collect())
    assert shown(got) == shown(want) == [(1, "x", -0.25), (1, "y", 4.0), (3, "y", -6.0)]


def test_chain_counts_level_by_level(spark):
    """Levels from the one above give the counts of all levels at once, near the start too, and shuffle positions once."""
    docs = spark.createDataFrame([("c", 1, "a b a b a c"), ("c", 2, "a b d"), ("c", 3, "a"), ("c", 4, "")], "corpus string, doc long, text string")
    t = lex(docs, before=2)
    got, want = contexts.ngram_chain_counts(t, 3), contexts.chain_counts(t, contexts.ngram_chain(3))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_differences_without_pairs_of_positions_and_candidates(spark):
    """The best of the whole vocabulary is found by backing off: ties, first positions and few counts as with all candidates."""
    import random

    r = random.Random(5)
    rows = [("c", d, p, r.choice("aabcdefgh"[: 3 + d % 7])) for d in range(40) for p in range(1, r.randint(2, 9))]
    rows += [("d", 1, 1, "b"), ("d", 1, 2, "a"), ("d", 2, 1, "b")]
    t = spark.createDataFrame(rows, "corpus string, doc long, pos long, token string")
    values, weights = {f"c{n}": F.log(F.col(f"c{n}") + F.lit(1.0)) for n in (1, 2, 3)}, {"c1": 0.5, "c2": 0.7, "c3": 0.9}
    g = counts.grams(t, 3)
    scored = candidates.scored(candidates.staged(t, counts.followers(g)), t, counts.ngram_counts(g))
    want = latent.differences_of(candidates.softmax(candidates.log_linear(scored, weights, values)), values, weights)
    got = latent.differences_of_all(t, values, weights)
    shown = lambda x: sorted((q.corpus, q.doc, q.pos, q.feature, round(q.difference, 9)) for q in x.collect())
    assert shown(got) == shown(want) and len(shown(got)) > 100


def _events(spark, path, users):
    rows = [(100_000 * u + i, i, u, x) for u, types in enumerate(users) for i, x in enumerate(types)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")


def test_feature_differences_with_missing_event_types(spark, tmp_path):
    import duckdb

    from tokenlm.plans.modelling import QUERIES, SQL

    _events(spark, tmp_path, [["a", "b", None, "a", "c", "b"], [None, "b", "a", "b", "a", None, None], ["c"], ["b", "a", "b", "c"]])
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["feature_differences"](spark, str(tmp_path)).collect()))
    assert got == sorted(duckdb.sql(SQL["feature_differences"]).fetchall()) and got


def test_feature_differences_pair_no_position_with_the_vocabulary(spark, tmp_path):
    from tokenlm.plans.modelling import QUERIES

    _events(spark, tmp_path, [[f"t{i}" for i in range(10_001)], ["a", "a", "a"]])
    assert [tuple(q) for q in QUERIES["feature_differences"](spark, str(tmp_path)).collect()] == [(0, 1, "c1", -0.346574)]
