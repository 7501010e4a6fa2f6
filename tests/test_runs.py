"""Entropy by runs of documents, against the counts of each position."""

from __future__ import annotations

import random

import pytest

from tokenlm.operators import prequential, runs


@pytest.mark.parametrize("run", [1, 60, 1 << 20])
def test_runs_give_the_entropy_of_counts_before(spark, run):
    r = random.Random(5)
    docs = [(c, d + (c == "en"), " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 60)))) for c in ("de", "en") for d in range(0, 90_000, 4000)]
    docs += [("en", 7, ""), ("en", 8, None), ("fr", 1, "a"), ("it", 2, ""), (None, 9, "a b c"), ("en", None, "a b c"), ("de", -5, "é 1.5 x_1 a b")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "corpus string, doc long, text string").repartition(3)
    want = {x.corpus: (x.n_tokens, x.entropy) for x in prequential.entropy(prequential.trigrams_before(df), 3).collect()}
    got = runs.entropy(df, run=run)
    assert got.columns == ["corpus", "n_tokens", "entropy"]
    got = {x.corpus: (x.n_tokens, x.entropy) for x in got.collect()}
    assert got.keys() == want.keys() == {"de", "en", "fr"}
    for c, (n, e) in want.items():
        assert got[c] == (n, pytest.approx(e, abs=1e-10))


def test_runs_of_no_documents(spark):
    assert runs.entropy(spark.createDataFrame([], "corpus string, doc long, text string")).collect() == []


def test_word_entropy_shuffles_no_row_per_position(spark, monkeypatch):
    from tokenlm.plans.counting import QUERIES

    def refuse(*args):
        raise AssertionError("each position is shuffled")

    monkeypatch.setattr(prequential, "trigrams_before", refuse)
    assert {"corpus", "n_tokens", "entropy"} == set(QUERIES["word_prequential_entropy"](spark, "/root/testdata/sf0.001").columns)


@pytest.mark.parametrize("run", [1, 60, 1 << 20])
def test_runs_give_counts_before(spark, run):
    r = random.Random(6)
    docs = [(c, d + (c == "en"), " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 60)))) for c in ("de", "en") for d in range(0, 90_000, 4000)]
    docs += [("en", 7, ""), ("en", 8, None), ("fr", 1, "a"), ("it", 2, ""), (None, 9, "a b c"), ("en", None, "a b c"), ("de", -5, "é 1.5 x_1 a b"), ("es", 3, "a a a a" * 20_000)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "corpus string, doc long, text string").repartition(3)
    want = prequential.trigrams_before(df)
    got = runs.counts(df, run=run)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_runs_leave_the_session_as_it_was(spark):
    from tokenlm.sources.shared import _CLEANUP

    before = spark.conf.get(_CLEANUP)
    assert runs.counts(spark.createDataFrame([], "corpus string, doc long, text string")).collect() == []
    assert spark.conf.get(_CLEANUP) == before


def test_word_counts_shuffle_no_row_per_position(spark):
    from tokenlm.plans.counting import QUERIES

    plan = QUERIES["word_prequential_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "token" in plan and "p1" not in plan and "Join" not in plan
