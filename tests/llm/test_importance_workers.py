"""Resampling starts Python workers of one kind only."""

from __future__ import annotations

from pyspark import SparkContext

from tokenlm.llm import importance


def test_fit_makes_no_rows_in_plain_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "bad other things " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")

    def refuse(*args, **kwargs):
        raise AssertionError("rows from the driver go through plain Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    model = importance.fit(docs, labels)
    assert model.slope > 0
