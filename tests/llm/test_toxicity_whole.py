"""Labelled rows beyond the start's bound are trained on."""

from __future__ import annotations

import numpy as np

from tokenlm.llm import toxicity


def test_words_met_only_beyond_the_start_are_learned(spark, monkeypatch):
    """The start takes a few rows, and most toxic words are in others."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 80)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000)
    bad = [f"{a}{b}x" for a in ("gru", "vil", "zor", "kwa", "plo", "mif", "dra", "sno") for b in ("bq", "tz", "kk", "pj", "wv")]
    r = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        w = [f"word{k}" for k in r.integers(0, 300, 12)]
        if i % 5 == 0:
            w[int(r.integers(12))] = bad[int(r.integers(len(bad)))]
        rows.append((i, " ".join(w), "en", int(i % 5 == 0)))
    rows += rows[:200]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    got = toxicity.toxicity(table, table.select("doc_id", "toxic")).collect()
    assert len(got) == len(rows)
    held = [(x.predicted, int(x.doc_id % 5 == 0)) for x in got if x.held_out]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05


def test_threshold_counts_repeats():
    score, y, times = np.array([0.1, 0.4, 0.6, 0.9]), np.array([0, 1, 0, 1]), np.array([5, 2, 1, 3])
    assert toxicity.best_threshold(score, y, times) == toxicity.best_threshold(np.repeat(score, times), np.repeat(y, times)) == 0.25


def test_put_takes_what_dense_gives():
    net, other = toxicity.Net(), toxicity.Net(4)
    rows = np.concatenate([other.p["e"], other.dense()])
    net.put(np.arange(len(rows)), rows)
    assert all((net.p[k] == other.p[k]).all() for k in net.p)
