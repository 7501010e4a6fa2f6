"""Labels of contexts, against counting in Python."""

from __future__ import annotations

from collections import Counter

from tokenlm.functions.scalars import BINS
from tokenlm.operators import packed


def expected(docs):
    def contexts(text):
        t = text.split()
        return [tuple(t[max(0, i - 2) : i]) for i in range(len(t))]

    total = Counter((c, x) for c, _, text in docs if text for x in contexts(text) if x)
    # A context of one token also counts where it isn't the longest.
    for c, _, text in docs:
        t = (text or "").split()
        total.update((c, (t[i - 1],)) for i in range(2, len(t)))
    out = []
    for c, d, text in docs:
        for i, x in enumerate(contexts(text or "")):
            n = total[c, x]
            label = next((f"<={b}" for b in BINS if n <= b), f">{BINS[-1]}")
            out.append((c, d, i + 1, f",total{len(x)}{label}" if x and c is not None and d is not None else ",empty"))
    return sorted(out, key=str)


def test_context_bins_hold_in_one_shuffle_over_runs_nulls_and_frequent_contexts(spark):
    docs = [("en", 1, "a b a b a c"), ("en", 2, "a b c"), ("de", 3, "a b a b"), ("de", 4, ""), ("de", 5, None), (None, 6, "a b c"), ("en", None, "a b a"), ("en", 7, "x " * 1200), ("en", 8, "y " * 600), ("de", 9, "y " * 1003), ("en", 10, "y " * 500), ("fr", 11, "a")]
    df = spark.createDataFrame(docs, "corpus string, doc long, text string").repartition(3)
    for run in (1, 1 << 21):
        got = packed.context_bins(df, run)
        assert got.columns == ["corpus", "doc", "pos", "annotation"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == expected(docs)


def test_bin_annotation_shuffles_no_rows_of_positions(spark):
    from tokenlm.plans.counting import QUERIES

    plan = QUERIES["bin_annotation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan
