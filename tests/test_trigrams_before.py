"""Counts before each position in two shuffles, against the general operator."""

from __future__ import annotations

import random

from tokenlm.operators import counts as C
from tokenlm.operators import prequential
from tokenlm.operators.tokens import lex


def test_trigrams_before_give_what_counts_before_gives(spark):
    r = random.Random(4)
    docs = [(c, d, " ".join(r.choice("abcde") for _ in range(r.randint(1, 40)))) for c in ("de", "en") for d in range(0, 90_000, 6000)]
    docs += [("en", 7, ""), ("en", 8, None), ("fr", 1, "a"), (None, 9, "a b c"), ("en", None, "a b c")]
    df = spark.createDataFrame(docs, "corpus string, doc long, text string").repartition(3)
    t = prequential.numbered(lex(df.dropna(subset=["corpus", "doc"])))
    names = ["corpus", "g", "n", "ngram", "c", "total", "followers", "kn", "kn_total"]
    slow = prequential.counts_before(C.grams(t, 3), t).select(*names)
    fast = prequential.trigrams_before(df)
    assert fast.columns == names
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_groups_hold_over_batches(spark):
    import pyarrow as pa

    rows = [("en", g, 2 + g % 2, None if g % 2 == 0 else "x", p, "ab"[g % 3 == 0]) for p in "pqr" for g in range(1, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], prequential._PAIRS)
    whole = pa.Table.from_batches(list(prequential._by_groups(iter([batch]))))
    parts = pa.Table.from_batches(list(prequential._by_groups(iter([batch.slice(i, 4) for i in range(0, len(rows), 4)]), least=8)))
    assert whole.to_pylist() == parts.to_pylist()


def test_word_entropy_takes_no_join_of_grams(spark, monkeypatch):
    from tokenlm.plans.counting import QUERIES

    def refuse(*args):
        raise AssertionError("grams are joined with their positions")

    monkeypatch.setattr(prequential, "counts_before", refuse)
    assert "entropy" in QUERIES["word_prequential_entropy"](spark, "/root/testdata/sf0.001").columns
